"""Extensions by published definitions: price adjustment, backtest, regression, factor research, risk and attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio


def _by(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy("day")


def adjusted(closes: DataFrame, actions: DataFrame) -> DataFrame:
    """(symbol, day, backward, forward): closes over the factors of all later actions, so that the last price stays, and times
    the factors of all actions so far, so that the first does. actions: (symbol, day, factor), such as 2 for a 2-for-1 split
    that holds from that day on; those of one day multiply."""
    daily = actions.groupBy("symbol", "day").agg(F.product("factor").alias("factor"))
    held = closes.join(daily, ["symbol", "day"], "left").withColumn("factor", F.coalesce("factor", F.lit(1.0)))
    later = F.product("factor").over(_by("symbol").rowsBetween(1, Window.unboundedFollowing))
    so_far = F.product("factor").over(_by("symbol").rowsBetween(Window.unboundedPreceding, 0))
    return held.select("symbol", "day", (F.col("close") / F.coalesce(later, F.lit(1.0))).alias("backward"), (F.col("close") * so_far).alias("forward"))


def limit_moves(closes: DataFrame, band: float = 0.1) -> DataFrame:
    """(symbol, day, move): 1 where a close stands at or above the day before times 1 + band, in cents, -1 below 1 - band, else 0."""
    before = F.lag("close").over(_by("symbol"))
    up, down = F.round(before * (1 + band), 2), F.round(before * (1 - band), 2)
    move = F.when(F.col("close") >= up, 1).when(F.col("close") <= down, -1).otherwise(0)
    return closes.select("symbol", "day", move.alias("move"))


def backtest(weights: DataFrame, returns: DataFrame, one_way_bps: float) -> DataFrame:
    """(day, gross, turnover, net, equity): weights (symbol, day, weight) earn the simple returns (symbol, day, ret) of the bar
    after; a change of weight is paid for on the bar on which it begins to earn. Bars without a weight weigh 0."""
    held = returns.join(weights, ["symbol", "day"], "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    lagged = F.coalesce(F.lag("weight").over(_by("symbol")), F.lit(0.0))
    moved = held.withColumn("lagged", lagged).withColumn("change", F.abs(F.col("lagged") - F.coalesce(F.lag("lagged").over(_by("symbol")), F.lit(0.0))))
    daily = moved.groupBy("day").agg(F.sum(F.col("lagged") * F.col("ret")).alias("gross"), F.sum("change").alias("turnover"))
    net = daily.withColumn("net", F.col("gross") - F.col("turnover") * one_way_bps / 10_000.0)
    # One row a day: the only window without a key.
    return net.withColumn("equity", F.product(1 + F.col("net")).over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))


def autocorrelations(returns: DataFrame, lags: int = 5) -> DataFrame:
    """(symbol, lag, acf): sample autocovariances over the variance, all about the whole mean."""
    mean, w = F.avg("ret").over(Window.partitionBy("symbol")), _by("symbol")
    centred = returns.select("symbol", "day", (F.col("ret") - mean).alias("x"))
    before = F.array(*[F.struct(F.lit(k).alias("lag"), F.lag("x", k).over(w).alias("y")) for k in range(1, lags + 1)])
    pairs = centred.withColumn("before", before).select("symbol", "x", F.explode("before").alias("p"))
    each = pairs.groupBy("symbol", "p.lag").agg(F.sum(F.col("x") * F.col("p.y")).alias("cov"), F.sum(F.col("x") * F.col("x")).alias("var"))
    return each.select("symbol", "lag", ratio(F.col("cov"), F.col("var")).alias("acf"))


def market_model(returns: DataFrame) -> DataFrame:
    """(symbol, alpha, beta, r2) of the regression on the equal-weighted mean return of all symbols of a day."""
    market = returns.groupBy("day").agg(F.avg("ret").alias("market"))
    y, x = F.col("ret"), F.col("market")
    return returns.join(market, "day").groupBy("symbol").agg(F.regr_intercept(y, x).alias("alpha"), F.regr_slope(y, x).alias("beta"), F.regr_r2(y, x).alias("r2"))


def ic_summary(ics: DataFrame) -> DataFrame:
    """(n, mean, std, icir, positive) of daily information coefficients (day, ic)."""
    held = ics.where("ic is not null").agg(F.count("ic").alias("n"), F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("std"), F.avg((F.col("ic") > 0).cast("double")).alias("positive"))
    return held.select("n", "mean", "std", ratio(F.col("mean"), F.col("std")).alias("icir"), "positive")


def neutralised(factors: DataFrame, column: str, group: str) -> DataFrame:
    """(symbol, day, neutral): a factor less the mean of its group and day."""
    return factors.select("symbol", "day", (F.col(column) - F.avg(column).over(Window.partitionBy("day", group))).alias("neutral"))


def long_short(ranked: DataFrame, buckets: int = 5) -> DataFrame:
    """(day, spread): the mean forward return of the top bucket less that of the bottom one, from (day, bucket, fwd)."""
    top, bottom = (F.avg(F.when(F.col("bucket") == b, F.col("fwd"))) for b in (buckets, 1))
    return ranked.groupBy("day").agg((top - bottom).alias("spread")).where("spread is not null")


def normal_value_at_risk(returns: DataFrame, z: float = -1.6448536269514722) -> DataFrame:
    """(symbol, var): the quantile of a normal distribution with the sample's mean and deviation; z is its standard score."""
    return returns.groupBy("symbol").agg((F.avg("ret") + F.lit(z) * F.stddev_samp("ret")).alias("var"))


def stress(returns: DataFrame, windows: DataFrame) -> DataFrame:
    """(window, symbol, n, total): compounded log returns inside named windows (window, from, to), a few rows."""
    inside = (F.col("day") >= F.col("from")) & (F.col("day") <= F.col("to"))
    held = returns.join(F.broadcast(windows), inside)
    return held.groupBy("window", "symbol").agg(F.count(F.lit(1)).alias("n"), (F.exp(F.sum("ret")) - 1).alias("total"))


def triple_barrier(closes: DataFrame, up: float = 0.02, down: float = 0.02, ahead: int = 10) -> DataFrame:
    """(symbol, day, label, bars): 1 or -1 for the barrier that the closes of the next bars touch first, after how many bars, and 0
    if none is touched in ``ahead`` bars. Days without so many bars ahead have no label."""
    later = F.collect_list("close").over(_by("symbol").rowsBetween(1, ahead))
    held = closes.select("symbol", "day", "close", later.alias("later")).where(F.size("later") == ahead)
    moves = F.transform("later", lambda c: F.when(c >= F.col("close") * (1 + up), 1).when(c <= F.col("close") * (1 - down), -1).otherwise(0))
    touched = F.filter(F.transform(moves, lambda m, k: F.struct((k + 1).alias("bars"), m.alias("label"))), lambda t: t["label"] != 0)
    first = held.select("symbol", "day", F.get(touched, F.lit(0)).alias("first"))
    return first.select("symbol", "day", F.coalesce("first.label", F.lit(0)).alias("label"), F.coalesce("first.bars", F.lit(ahead)).alias("bars"))


def purged_folds(days: DataFrame, folds: int = 5, embargo: int = 10) -> DataFrame:
    """(day, fold, test_fold, purged): contiguous folds of days; for each test fold, the training days within ``embargo`` days
    of it are purged. One row a day and test fold that it isn't in."""
    numbered = days.select("day").distinct().withColumn("k", F.row_number().over(Window.orderBy("day")) - 1)
    placed = numbered.withColumn("fold", F.ntile(folds).over(Window.orderBy("day")) - 1)
    bounds = placed.groupBy("fold").agg(F.min("k").alias("first"), F.max("k").alias("last")).withColumnRenamed("fold", "test_fold")
    trained = placed.join(F.broadcast(bounds), F.col("fold") != F.col("test_fold"))  # as many rows as folds
    purged = (F.col("k") >= F.col("first") - embargo) & (F.col("k") <= F.col("last") + embargo)
    return trained.select("day", "fold", "test_fold", purged.alias("purged"))


def attribution(sectors: DataFrame) -> DataFrame:
    """(day, allocation, selection, interaction) from (day, sector, wp, rp, wb, rb): weights and returns of portfolio and benchmark."""
    total = F.sum(F.col("wb") * F.col("rb")).over(Window.partitionBy("day"))
    held = sectors.withColumn("all", total)
    more = F.col("wp") - F.col("wb")
    return held.groupBy("day").agg(
        F.sum(more * (F.col("rb") - F.col("all"))).alias("allocation"),
        F.sum(F.col("wb") * (F.col("rp") - F.col("rb"))).alias("selection"),
        F.sum(more * (F.col("rp") - F.col("rb"))).alias("interaction"),
    )


def normal_cdf(x: Column) -> Column:
    """The standard normal distribution function: the published rational approximation 26.2.17 (error below 7.5e-8)."""
    # Coefficients of the approximation.
    p, terms = 0.2316419, (1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530)
    t = 1 / (1 + F.lit(p) * F.abs(x))
    poly = F.lit(terms[0])
    for c in terms[1:]:
        poly = poly * t + F.lit(c)
    tail = F.exp(-x * x / 2) / F.lit(2.5066282746310002) * poly * t
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def black_scholes(options: DataFrame, rate: float = 0.02) -> DataFrame:
    """Adds call, put and delta to (spot, strike, years, vol); null where years or vol aren't above 0."""
    known = (F.col("years") > 0) & (F.col("vol") > 0)
    spread = F.col("vol") * F.sqrt("years")
    d1 = F.when(known, (F.log(F.col("spot") / F.col("strike")) + (F.lit(rate) + F.col("vol") * F.col("vol") / 2) * F.col("years")) / spread)
    present = F.col("strike") * F.exp(F.lit(-rate) * F.col("years"))
    call = F.col("spot") * normal_cdf(d1) - present * normal_cdf(d1 - spread)
    return options.withColumns({"call": call, "put": call - F.col("spot") + present, "delta": normal_cdf(d1)})
