"""URL filters with DataFrame expressions only: host rules, and a logistic regression on hashed character n-grams of host
and path for the rest, trained from a small labelled URL table.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Verdict, host and path prefix of each rule.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: Labelled URLs for training: 1 is to be blocked. Hosts are words of everyday languages below domains kept for documentation.
BLOCKED = """
http://poker-jackpot.example.com/join  https://www.royal-roulette.example.org/en/bonus  http://slots-vegas.example.net/700
https://lottery-numbers.example.com/claim  http://blackjack-club.example.org/de/12?ref=mail  https://m.bingo-palace.example.net/vip
http://viagra-shop.example.com/order  https://diet-miracle.example.org/es/5  http://pharmacy-discount.example.net/buy
https://weight-loss.example.com/en/30.html  http://steroid-store.example.org/cart  https://www.hair-growth.example.net/offer
http://porn-tube.example.com/watch  https://xxx-videos.example.org/en/9  http://sexy-webcams.example.net/live
https://hot-singles.example.com/chat  http://escort-girls.example.org/fr/3  https://nude-photos.example.net/gallery
http://popup-banner.example.com/click  https://pixel-server.example.org/c?id=77  http://click-network.example.net/imp
https://affiliate-links.example.com/go  http://doorway-pages.example.org/en/404  https://backlink-service.example.net/seo
http://payday-loans.example.com/apply  https://quick-credit.example.org/now  http://crypto-doubler.example.net/invest
https://inheritance-fund.example.com/reply  http://bank-verify.example.org/login  https://account-suspended.example.net/update
http://malware-download.example.com/setup.exe  https://keygen-crack.example.org/serial  http://warez-archive.example.net/iso
https://replica-watches.example.com/sale  http://fake-passports.example.org/de/1  https://followers-shop.example.net/buy
http://blog.luxury-handbags.example.com/outlet  https://m.binary-options.example.org/en/trade  http://www.penny-stocks.example.net/tips
https://prize-winner.example.com/en/1#top  http://gift-cards.example.org/es/88?page=2  https://survey-rewards.example.net/start
"""
ALLOWED = """
http://www.library.example.com/catalogue/12  https://museum.example.org/en/visit  http://garden.example.net/tomatoes
https://blog.kitchen.example.com/en/450?page=2  http://weather.example.org/today  https://m.school.example.net/maths/101
http://recipes.example.com/soup  https://www.mountains.example.org/de/12  http://river.example.net/en/77.html
https://docs.example.com/guide/start  http://history.example.org/fr/9  https://forum.example.net/thread/88
http://science.example.com/en/2024/05  https://music.example.org/es/5  http://theatre.example.net/season
https://www.hospital.example.com/doctors  http://council.example.org/minutes  https://sports.example.net/results/9
http://travel.example.com/norway  https://m.books.example.org/en/31  http://newspaper.example.net/en/700
https://bibliothek.example.com/de/20  http://jardin.example.org/fr/8  https://escuela.example.net/es/19#top
http://blog.astronomy.example.com/en/2  https://www.orchestra.example.org/en/9/  http://painting.example.net/en/3.html
https://m.railway.example.com/de/6?ref=x  http://bakery.example.org/fr/1  https://blog.cycling.example.net/en/55
http://university.example.com/courses  https://botany.example.org/ferns  http://www.lighthouse.example.net/tours
https://village.example.com/en/404  http://harbour.example.org/es/88?page=2  https://blog.teacher.example.net/lessons
http://m.choir.example.com/concert  https://observatory.example.org/en/1#top  http://carpentry.example.net/chairs
https://www.farmers.example.com/en/30.html  http://town.example.org/de/1  https://source.example.net/download
http://wetter.example.com/de/511  https://cuisine.example.org/fr/825?utm_source=feed  http://blog.mercado.example.net/es/748
"""
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Hash buckets of the n-grams, their lengths, and the regularisation of the fit.
BUCKETS, GRAMS, PENALTY = 1 << 12, (1, 2), 0.003


def host(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, "^[\\s\\S]*?://([^/?#]*)", 1), *LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "^[\\s\\S]*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the longest rule that fits, or null: a rule fits its host and all subdomains."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, of, prefix in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == of) | F.endswith(host, F.lit("." + of))) & F.startswith(path, F.lit(prefix))
        out = F.when(fits, F.struct(F.lit(of + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _only(f):
    """A lambda of one argument: Spark passes the index to a second one."""
    return lambda i: f(i)


def buckets(host: Column, path: Column, size: int = BUCKETS) -> Column:
    """The distinct hash buckets of the character n-grams of host and path, each marked by its part."""

    def grams(text: Column, mark: str) -> list[Column]:
        held = F.concat(F.lit(mark), text, F.lit("$"))
        out = []
        for n in GRAMS:

            def at(i: Column, n: int = n) -> Column:
                return F.substring(held, i, F.lit(n))

            places = F.sequence(F.lit(1), F.greatest(F.length(held) - n + 1, F.lit(1)))
            short = F.array().cast("array<string>")
            out.append(F.when(F.length(held) >= n, F.transform(places, _only(at))).otherwise(short))
        return out

    every = F.concat(*grams(host, "^"), *grams(path, "~"))
    return F.array_distinct(F.transform(every, lambda g: F.pmod(F.xxhash64(g), F.lit(size)).cast("int")))


def labelled_urls(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(u, 1.0) for u in BLOCKED.split()] + [(u, 0.0) for u in ALLOWED.split()], "url string, label double"
    )


def train(labelled: DataFrame, size: int = BUCKETS, penalty: float = PENALTY) -> tuple[list[float], float]:
    """Weights by bucket and the intercept, from (url, label 1.0 to block). The table is small by contract: it is fitted as
    one partition, so that every run adds in one order. Without both labels there is no model: all weights are 0.
    """
    ready = labelled.where("label is not null")
    if ready.select("label").distinct().count() < 2:
        return [0.0] * size, 0.0
    of = buckets(host(F.col("url")), path(F.col("url")), size)
    # The exchange keeps the planner from computing the buckets anew for each element below.
    held = ready.select("label", "url", of.alias("at")).repartition(1).sortWithinPartitions("label", "url")
    dense = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.array_contains("at", i).cast("double"))
    model = LogisticRegression(maxIter=50, regParam=penalty, standardization=False).fit(
        held.select("label", array_to_vector(dense).alias("features"))
    )
    return [float(x) for x in model.coefficients.toArray()], float(model.intercept)


def filter_urls(pages: DataFrame, weights: list[float], intercept: float, rules=RULES) -> DataFrame:
    """Host, path, rule, verdict and score of every row of (page_id, url); ``page_id`` may be null or repeat.

    The longest rule that fits decides; without one, block if the regression's probability is at least 0.5. A null or
    empty url, or one without ://, has empty host and path, so the regression judges the empty n-grams. Rules are a short
    list (each is one expression); other columns are ignored; an empty table gives no rows.
    """
    lookup = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")  # folds to one literal
    parts = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    ruled = parts.withColumn("ruled", best_rule(F.col("host"), F.col("path"), rules))
    logit = F.aggregate(
        buckets(F.col("host"), F.col("path"), len(weights)), F.lit(intercept), lambda acc, b: acc + F.get(lookup, b)
    )
    scored = ruled.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-logit)))
    return scored.select(
        "page_id",
        "host",
        "path",
        F.col("ruled.rule").alias("rule"),
        F.coalesce("ruled.verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"),
        "score",
    )
