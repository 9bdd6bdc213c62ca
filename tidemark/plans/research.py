"""Registered queries of the extensions in ``operators.research``, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import analytics, research
from .catalogue import ALIGNED, SUPPLY, closes, query, r, read, returns, supply

SIMPLE = f"{ALIGNED}, s AS (SELECT * FROM (SELECT symbol, day, close / lag(close) OVER (PARTITION BY symbol ORDER BY day) - 1 AS ret FROM c) WHERE ret IS NOT NULL)"
AHEAD = f"{SUPPLY}, g AS (SELECT symbol, day, momentum AS factor, lead(momentum) OVER (PARTITION BY symbol ORDER BY day) / momentum - 1 AS fwd FROM f)"


def simple_returns(spark, d):
    before = F.lag("close").over(Window.partitionBy("symbol").orderBy("day"))
    return closes(spark, d).select("symbol", "day", (F.col("close") / before - 1).alias("ret")).where("ret is not null")


def ahead(spark, d):
    w = Window.partitionBy("symbol").orderBy("day")
    return supply(spark, d).select("symbol", "day", F.col("momentum").alias("factor"), (F.lead("momentum").over(w) / F.col("momentum") - 1).alias("fwd"))


# Prices and means with few decimals are divided by pi, so that none is a tie of the rounding.


@query(f"""WITH {ALIGNED}, a AS (SELECT *, CASE WHEN dayofyear(day) = 100 THEN 3.0 ELSE 1.0 END::DOUBLE AS factor FROM c)
    SELECT symbol, day, round(close / coalesce(product(factor) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1) / pi(), 4) + 0.0 AS backward,
        round(close * product(factor) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / pi(), 4) + 0.0 AS forward FROM a""")
def price_adjustment(spark, d):
    held = closes(spark, d)
    splits = held.where(F.dayofyear("day") == 100).select("symbol", "day", F.lit(3.0).alias("factor"))
    return research.adjusted(held, splits).select("symbol", "day", *(r(F.col(c) / F.pi(), 4).alias(c) for c in ("backward", "forward")))


@query(f"""WITH {ALIGNED}, p AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY day) AS before FROM c)
    SELECT symbol, count_if(close >= round(before * 1.1, 2)) AS up, count_if(close <= round(before * 0.9, 2)) AS down FROM p GROUP BY symbol""")
def limit_moves(spark, d):
    found = research.limit_moves(closes(spark, d))
    return found.groupBy("symbol").agg(F.count_if(F.col("move") == 1).alias("up"), F.count_if(F.col("move") == -1).alias("down"))


@query(f"""WITH {SIMPLE}, w AS (SELECT symbol, day, CASE WHEN ret > 0 THEN 1.0 / 3 ELSE 0 END::DOUBLE AS weight FROM s),
    l AS (SELECT symbol, day, ret, coalesce(lag(weight) OVER (PARTITION BY symbol ORDER BY day), 0) AS held FROM s JOIN w USING (symbol, day)),
    t AS (SELECT *, abs(held - coalesce(lag(held) OVER (PARTITION BY symbol ORDER BY day), 0)) AS change FROM l),
    n AS (SELECT day, sum(held * ret) AS gross, sum(change) AS turnover FROM t GROUP BY day)
    SELECT day, round(gross, 8) + 0.0 AS gross, round(turnover, 8) + 0.0 AS turnover, round(gross - turnover * 7.7 / 10000, 8) + 0.0 AS net FROM n""")
def backtest_lagged(spark, d):
    held = simple_returns(spark, d)
    weights = held.select("symbol", "day", F.when(F.col("ret") > 0, F.lit(1.0) / 3).otherwise(F.lit(0.0)).alias("weight"))
    return research.backtest(weights, held, 7.7).select("day", r("gross", 8), r("turnover", 8), r("net", 8))


@query(f"""WITH {ALIGNED}, x AS (SELECT symbol, day, ret - avg(ret) OVER (PARTITION BY symbol) AS x FROM ret),
    l AS (SELECT symbol, x, k, CASE k WHEN 1 THEN lag(x, 1) OVER w WHEN 2 THEN lag(x, 2) OVER w WHEN 3 THEN lag(x, 3) OVER w END AS y FROM x, range(1, 4) AS t(k) WINDOW w AS (PARTITION BY symbol, k ORDER BY day))
    SELECT symbol, k::INTEGER AS lag, round(sum(x * y) / sum(x * x), 6) + 0.0 AS acf FROM l GROUP BY symbol, k""")
def autocorrelation(spark, d):
    return research.autocorrelations(returns(spark, d), 3).select("symbol", "lag", r("acf"))


@query(f"""WITH {ALIGNED}, m AS (SELECT day, avg(ret) AS market FROM ret GROUP BY day)
    SELECT symbol, round(regr_intercept(ret, market), 8) + 0.0 AS alpha, round(regr_slope(ret, market), 6) + 0.0 AS beta, round(regr_r2(ret, market), 6) + 0.0 AS r2 FROM ret JOIN m USING (day) GROUP BY symbol""")
def market_model(spark, d):
    return research.market_model(returns(spark, d)).select("symbol", r("alpha", 8), r("beta"), r("r2"))


@query(f"""WITH {AHEAD}, k AS (SELECT day, rank() OVER (PARTITION BY day ORDER BY factor) + (count(*) OVER (PARTITION BY day, factor) - 1) / 2 AS x,
        rank() OVER (PARTITION BY day ORDER BY fwd) + (count(*) OVER (PARTITION BY day, fwd) - 1) / 2 AS y FROM g WHERE fwd IS NOT NULL),
    i AS (SELECT day, CASE WHEN stddev_samp(x) > 0 AND stddev_samp(y) > 0 THEN corr(x, y) END AS ic FROM k GROUP BY day)
    SELECT count(ic) AS n, round(avg(ic), 6) + 0.0 AS mean, round(stddev_samp(ic), 6) AS std, round(avg(ic) / stddev_samp(ic), 5) + 0.0 AS icir, round(avg((ic > 0)::INTEGER), 6) AS positive FROM i WHERE ic IS NOT NULL""")
def ic_summary(spark, d):
    found = analytics.information_coefficient(ahead(spark, d))
    return research.ic_summary(found).select("n", r("mean"), r("std"), r("icir", 5), r("positive"))


@query(f"WITH {SUPPLY} SELECT symbol, day, round((momentum - avg(momentum) OVER (PARTITION BY day, length(symbol))) / pi(), 3) + 0.0 AS neutral FROM f")
def neutralised_factor(spark, d):
    return research.neutralised(supply(spark, d).withColumn("size", F.length("symbol")), "momentum", "size").select("symbol", "day", r(F.col("neutral") / F.pi(), 3).alias("neutral"))


@query(f"""WITH {AHEAD}, b AS (SELECT day, fwd, ntile(5) OVER (PARTITION BY day ORDER BY factor, symbol) AS bucket FROM g WHERE fwd IS NOT NULL)
    SELECT day, round(avg(fwd) FILTER (bucket = 5) - avg(fwd) FILTER (bucket = 1), 6) + 0.0 AS spread FROM b GROUP BY day HAVING count_if(bucket = 5) > 0 AND count_if(bucket = 1) > 0""")
def long_short(spark, d):
    known = ahead(spark, d).where("fwd is not null")
    ranked = known.withColumn("bucket", F.ntile(5).over(Window.partitionBy("day").orderBy("factor", "symbol")))
    return research.long_short(ranked).select("day", r("spread"))


@query(f"WITH {ALIGNED} SELECT symbol, round(avg(ret) - 1.6448536269514722 * stddev_samp(ret), 6) + 0.0 AS var FROM ret GROUP BY symbol")
def normal_var(spark, d):
    return research.normal_value_at_risk(returns(spark, d)).select("symbol", r("var"))


@query(f"""WITH {ALIGNED}, w AS (SELECT * FROM (VALUES ('spring', DATE '1994-03-01', DATE '1994-05-31'), ('year', DATE '1996-01-01', DATE '1996-12-31')) AS t("window", f, t))
    SELECT "window", symbol, count(*) AS n, round(exp(sum(ret)) - 1, 6) + 0.0 AS total FROM ret JOIN w ON day BETWEEN f AND t GROUP BY ALL""")
def stress_windows(spark, d):
    windows = spark.createDataFrame([("spring", "1994-03-01", "1994-05-31"), ("year", "1996-01-01", "1996-12-31")], "window string, from string, to string")
    dated = windows.select("window", F.to_date("from").alias("from"), F.to_date("to").alias("to"))
    return research.stress(returns(spark, d), dated).select("window", "symbol", "n", r("total"))


@query(f"""WITH {ALIGNED}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM c),
    t AS (SELECT a.symbol, a.day, min(CASE WHEN b.close >= a.close * 1.05 THEN b.k - a.k END) AS up, min(CASE WHEN b.close <= a.close * 0.95 THEN b.k - a.k END) AS down
        FROM n a JOIN n b ON a.symbol = b.symbol AND b.k BETWEEN a.k + 1 AND a.k + 10 WHERE a.k + 10 <= a.n GROUP BY a.symbol, a.day)
    SELECT symbol, day, CASE WHEN up IS NULL AND down IS NULL THEN 0 WHEN down IS NULL OR up < down THEN 1 ELSE -1 END::INTEGER AS label, least(coalesce(up, 10), coalesce(down, 10))::INTEGER AS bars FROM t""")
def triple_barrier(spark, d):
    return research.triple_barrier(closes(spark, d), 0.05, 0.05, 10)


@query(f"""WITH {ALIGNED}, p AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS place, ntile(5) OVER (ORDER BY day) - 1 AS fold FROM (SELECT DISTINCT day FROM c)),
    b AS (SELECT fold AS test_fold, min(place) AS first, max(place) AS last FROM p GROUP BY fold)
    SELECT fold::INTEGER AS fold, test_fold::INTEGER AS test_fold, count(*) AS days, count_if(place >= first - 10 AND place <= last + 10) AS purged FROM p JOIN b ON fold <> test_fold GROUP BY ALL""")
def purged_folds(spark, d):
    found = research.purged_folds(closes(spark, d))
    return found.groupBy("fold", "test_fold").agg(F.count(F.lit(1)).alias("days"), F.count_if("purged").alias("purged"))


@query("""WITH x AS (SELECT date_trunc('month', o_orderdate)::DATE AS day, o_orderpriority AS sector, sum(o_totalprice) AS a, count(*) AS b, avg(o_totalprice) / 1000000 AS rp, max(o_totalprice) / 1000000 AS rb FROM orders GROUP BY ALL),
    w AS (SELECT day, a / sum(a) OVER (PARTITION BY day) AS wp, b / sum(b) OVER (PARTITION BY day) AS wb, rp, rb FROM x), t AS (SELECT *, sum(wb * rb) OVER (PARTITION BY day) AS total FROM w)
    SELECT day, round(sum((wp - wb) * (rb - total)), 7) + 0.0 AS allocation, round(sum(wb * (rp - rb)), 7) + 0.0 AS selection, round(sum((wp - wb) * (rp - rb)), 7) + 0.0 AS interaction FROM t GROUP BY day""")
def sector_attribution(spark, d):
    day = Window.partitionBy("day")
    held = read(spark, d, "orders").groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("day"), F.col("o_orderpriority").alias("sector")).agg(
        F.sum("o_totalprice").alias("a"), F.count(F.lit(1)).alias("b"), (F.avg("o_totalprice") / 1_000_000).alias("rp"), (F.max("o_totalprice") / 1_000_000).alias("rb")
    )
    weighed = held.select("day", "sector", (F.col("a") / F.sum("a").over(day)).alias("wp"), (F.col("b") / F.sum("b").over(day)).alias("wb"), "rp", "rb")
    return research.attribution(weighed).select("day", r("allocation", 7), r("selection", 7), r("interaction", 7))


_CDF = "(CASE WHEN {x} >= 0 THEN 1 - {t} ELSE {t} END)"


def _cdf(x: str) -> str:
    t = f"(1 / (1 + 0.2316419::DOUBLE * abs({x})))"
    poly = f"((((1.330274429::DOUBLE * {t} - 1.821255978::DOUBLE) * {t} + 1.781477937::DOUBLE) * {t} - 0.356563782::DOUBLE) * {t} + 0.319381530::DOUBLE)"
    return _CDF.format(x=x, t=f"(exp(-{x} * {x} / 2) / sqrt(2 * pi()) * {poly} * {t})")


@query(f"""WITH o AS (SELECT p_partkey AS id, p_retailprice AS spot, p_retailprice * (0.8::DOUBLE + 0.05::DOUBLE * (p_size % 9)) AS strike, (p_size % 5)::DOUBLE / 4 AS years, 0.2::DOUBLE AS vol FROM part),
    e AS (SELECT *, CASE WHEN years > 0 THEN (ln(spot / strike) + (0.02::DOUBLE + vol * vol / 2) * years) / (vol * sqrt(years)) END AS d1, strike * exp(-0.02::DOUBLE * years) AS present FROM o),
    p AS (SELECT *, d1 - vol * sqrt(years) AS d2 FROM e), c AS (SELECT *, {_cdf("d1")} AS delta, CASE WHEN d1 IS NOT NULL THEN spot * {_cdf("d1")} - present * {_cdf("d2")} END AS call FROM p)
    SELECT id, round(call, 4) + 0.0 AS call, round(call - spot + present, 4) + 0.0 AS put, round(CASE WHEN d1 IS NOT NULL THEN delta END, 6) + 0.0 AS delta FROM c""")
def option_prices(spark, d):
    size = F.col("p_size")
    options = read(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("spot"), (F.col("p_retailprice") * (F.lit(0.8) + F.lit(0.05) * (size % 9))).alias("strike"),
        ((size % 5).cast("double") / 4).alias("years"), F.lit(0.2).alias("vol"),
    )
    return research.black_scholes(options).select("id", r("call", 4), r("put", 4), r("delta"))
