"""Return analytics over bars in long form (symbol, day, close).

Windows run by symbol. Cross-symbol work starts from one shuffle by day; only tables of one row per day are ever ordered
without a key.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import inverse_normal, ratio

YEAR = 252


def _by(*keys: str):
    return Window.partitionBy(*keys).orderBy("day")


def align(bars: DataFrame, symbols: list[str]) -> DataFrame:
    """(day, one close per symbol) on the days that all of them have: one shuffle by day and no joins."""
    wide = bars.where(F.col("symbol").isin(*symbols)).groupBy("day").pivot("symbol", symbols).agg(F.first("close"))
    return wide.na.drop()


def long(wide: DataFrame, symbols: list[str], name: str) -> DataFrame:
    """(day, symbol, value) of a wide table."""
    return wide.select("day", F.explode(F.array(*[F.struct(F.lit(s).alias("symbol"), F.col(f"`{s}`").alias(name)) for s in symbols])).alias("x")).select("day", "x.*")


def aligned(bars: DataFrame, symbols: list[str]) -> DataFrame:
    """Long bars (day, symbol, close) on the days that all symbols have, ready for windows by symbol."""
    return long(align(bars, symbols), symbols, "close")


def log_returns(closes: DataFrame) -> DataFrame:
    """(symbol, day, ret): ln of close over the close before; the first day of a symbol and prices not above 0 have none."""
    before = F.lag("close").over(_by("symbol"))
    ret = F.when((F.col("close") > 0) & (before > 0), F.log(F.col("close") / before))
    return closes.withColumn("ret", ret).where("ret is not null").select("symbol", "day", "ret")


def moments(returns: DataFrame) -> DataFrame:
    """Per symbol: n, mean, sample deviation, extremes, annualised return, volatility and Sharpe ratio, adjusted skewness and
    excess kurtosis. Null where the sample is too small or the deviation is 0."""
    n = F.col("n")
    base = returns.groupBy("symbol").agg(
        F.count("ret").alias("n"),
        F.avg("ret").alias("mean"),
        F.stddev_samp("ret").alias("std"),
        F.min("ret").alias("min"),
        F.max("ret").alias("max"),
        F.var_pop("ret").alias("__v"),
        F.skewness("ret").alias("__s"),
        F.kurtosis("ret").alias("__k"),
    )
    skew = F.when((n >= 3) & (F.col("__v") > 0), F.col("__s") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when((n >= 4) & (F.col("__v") > 0), (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("__k") + 6))
    return base.select(
        "symbol",
        "n",
        "mean",
        "std",
        "min",
        "max",
        (F.col("mean") * YEAR).alias("annual_return"),
        (F.col("std") * math.sqrt(YEAR)).alias("annual_vol"),
        (ratio(F.col("mean"), F.col("std")) * math.sqrt(YEAR)).alias("sharpe"),
        skew.alias("skew"),
        kurt.alias("kurtosis"),
    )


def rolling_vol(returns: DataFrame, window: int = 20) -> DataFrame:
    """(symbol, day, vol): annualised sample deviation of the last ``window`` returns; null before there are that many."""
    w = _by("symbol").rowsBetween(1 - window, 0)
    vol = F.when(F.count("ret").over(w) >= window, F.stddev_samp("ret").over(w) * math.sqrt(YEAR))
    return returns.select("symbol", "day", vol.alias("vol"))


def _pearson(x: Column, y: Column, agg) -> Column:
    """Correlation from covariances; null, not an error, where a side is constant."""
    return ratio(agg(F.covar_samp(x, y)), agg(F.stddev_samp(x)) * agg(F.stddev_samp(y)))


def pairs(returns: DataFrame) -> DataFrame:
    """(day, a, b, x, y): the returns of each pair of symbols a < b on their common days."""
    left = returns.select("day", F.col("symbol").alias("a"), F.col("ret").alias("x"))
    right = returns.select("day", F.col("symbol").alias("b"), F.col("ret").alias("y"))
    return left.join(right, "day").where("a < b")


def correlations(returns: DataFrame) -> DataFrame:
    """(a, b, n, corr) of all pairs of symbols."""
    found = pairs(returns).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), _pearson(F.col("x"), F.col("y"), lambda c: c).alias("corr"))
    return found


def rolling_correlations(returns: DataFrame, window: int = 60) -> DataFrame:
    """(a, b, day, corr) over the last ``window`` common days; null before there are that many."""
    w = _by("a", "b").rowsBetween(1 - window, 0)
    corr = _pearson(F.col("x"), F.col("y"), lambda c: c.over(w))
    return pairs(returns).select("a", "b", "day", F.when(F.count(F.lit(1)).over(w) >= window, corr).alias("corr"))


def cumulative(returns: DataFrame) -> DataFrame:
    """(symbol, day, curve, growth): the product of 1 + r over the first such factor, which takes log returns for simple ones,
    and the exact growth exp(sum of r)."""
    w = _by("symbol").rowsBetween(Window.unboundedPreceding, 0)
    curve = F.product(1 + F.col("ret")).over(w)
    first = F.first(1 + F.col("ret")).over(w)
    return returns.select("symbol", "day", ratio(curve, first).alias("curve"), F.exp(F.sum("ret").over(w)).alias("growth"))


def histogram(returns: DataFrame, bins: int = 80) -> DataFrame:
    """(symbol, bin, n): counts in equal bins between a symbol's extremes; the maximum falls in the last bin."""
    span = returns.groupBy("symbol").agg(F.min("ret").alias("low"), F.max("ret").alias("high"))
    at = F.when(F.col("high") > F.col("low"), F.floor((F.col("ret") - F.col("low")) / (F.col("high") - F.col("low")) * bins)).otherwise(0)
    placed = returns.join(F.broadcast(span) if _few(span) else span, "symbol").select("symbol", F.least(at, F.lit(bins - 1)).cast("int").alias("bin"))
    return placed.groupBy("symbol", "bin").agg(F.count(F.lit(1)).alias("n"))


def _few(keys: DataFrame, most: int = 100_000) -> bool:
    """Whether a table of one row per symbol is small enough to be broadcast."""
    return keys.limit(most + 1).count() <= most


def normal_quantiles(returns: DataFrame) -> DataFrame:
    """(symbol, rank, theoretical, sample): ordered returns against Filliben's order statistic medians."""
    n, i = F.col("n"), F.col("rank")
    ranked = returns.select(
        "symbol",
        F.col("ret").alias("sample"),
        F.row_number().over(Window.partitionBy("symbol").orderBy("ret")).alias("rank"),
        F.count(F.lit(1)).over(Window.partitionBy("symbol")).alias("n"),
    )
    last = F.pow(F.lit(0.5), 1 / n)
    p = F.when(i == 1, 1 - last).when(i == n, last).otherwise((i - 0.3175) / (n + 0.365))
    return ranked.select("symbol", "rank", inverse_normal(p).alias("theoretical"), "sample")


def normal_fit(returns: DataFrame) -> DataFrame:
    """(symbol, slope, intercept, r) of the least squares line through the quantile plot."""
    q = normal_quantiles(returns)
    x, y = F.col("theoretical"), F.col("sample")
    return q.groupBy("symbol").agg(
        ratio(F.covar_samp(x, y), F.var_samp(x)).alias("slope"),
        (F.avg(y) - ratio(F.covar_samp(x, y), F.var_samp(x)) * F.avg(x)).alias("intercept"),
        _pearson(x, y, lambda c: c).alias("r"),
    )


def density(returns: DataFrame, points: int = 50) -> DataFrame:
    """(symbol, x, density): Gaussian kernel density with Scott's bandwidth on an even grid between a symbol's extremes.

    Every grid point sums over the returns by a partial aggregation; the grid is ``points`` rows a symbol.
    """
    stats = returns.groupBy("symbol").agg(
        F.min("ret").alias("low"), F.max("ret").alias("high"), F.count(F.lit(1)).alias("n"), (F.stddev_samp("ret") * F.pow(F.count(F.lit(1)), F.lit(-0.2))).alias("h")
    )
    grid = stats.where("h > 0").withColumn("at", F.sequence(F.lit(0), F.lit(points - 1)))
    placed = returns.join(grid, "symbol").select("symbol", "ret", "h", "n", F.explode(F.transform("at", lambda k: F.col("low") + (F.col("high") - F.col("low")) * k / (points - 1))).alias("x"))
    z = (F.col("x") - F.col("ret")) / F.col("h")
    return placed.groupBy("symbol", "x").agg((F.sum(F.exp(-z * z / 2)) / (F.first("n") * F.first("h") * math.sqrt(2 * math.pi))).alias("density"))


# Extensions: published definitions, no counterpart to match.


def sma(closes: DataFrame, n: int = 20) -> DataFrame:
    w = _by("symbol").rowsBetween(1 - n, 0)
    return closes.select("symbol", "day", F.when(F.count("close").over(w) >= n, F.avg("close").over(w)).alias("sma"))


def bollinger(closes: DataFrame, n: int = 20, width: float = 2.0) -> DataFrame:
    """Mean and mean +- width population deviations."""
    w = _by("symbol").rowsBetween(1 - n, 0)
    full = F.count("close").over(w) >= n
    mid, dev = F.avg("close").over(w), F.stddev_pop("close").over(w)
    return closes.select("symbol", "day", F.when(full, mid).alias("mid"), F.when(full, mid + width * dev).alias("upper"), F.when(full, mid - width * dev).alias("lower"))


def atr(bars: DataFrame, n: int = 14) -> DataFrame:
    """Mean true range of the last n bars of (symbol, day, high, low, close)."""
    before = F.lag("close").over(_by("symbol"))
    true_range = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    w = _by("symbol").rowsBetween(1 - n, 0)
    ranged = bars.select("symbol", "day", true_range.alias("tr"))
    return ranged.select("symbol", "day", F.when(F.count("tr").over(w) >= n, F.avg("tr").over(w)).alias("atr"))


def rsi(closes: DataFrame, n: int = 14) -> DataFrame:
    """Cutler's variant: simple averages of gains and losses; 100 where there is no loss but a gain, null where neither."""
    change = F.col("close") - F.lag("close").over(_by("symbol"))
    moved = closes.select("symbol", "day", change.alias("d")).where("d is not null")
    w = _by("symbol").rowsBetween(1 - n, 0)
    gain, loss = F.avg(F.greatest(F.col("d"), F.lit(0.0))).over(w), F.avg(F.greatest(-F.col("d"), F.lit(0.0))).over(w)
    return moved.select("symbol", "day", F.when(F.count("d").over(w) >= n, 100 * ratio(gain, gain + loss)).alias("rsi"))


def ema(closes: DataFrame, spans: tuple[int, ...] = (12, 26)) -> DataFrame:
    """Exponential averages e = a x + (1 - a) e_before, a = 2 / (span + 1), from the first close on.

    The recursion has no expression in Spark; a symbol's closes, one number a day, pass through pandas in order.
    """
    names = [f"ema_{s}" for s in spans]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day")
        for name, span in zip(names, spans, strict=True):
            pdf[name] = pdf["close"].ewm(span=span, adjust=False).mean()
        return pdf[["symbol", "day", *names]]

    kind = dict(closes.dtypes)["day"]
    return closes.select("symbol", "day", "close").groupBy("symbol").applyInPandas(run, f"symbol string, day {kind}, " + ", ".join(f"{n} double" for n in names))


def macd(closes: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    both = ema(closes, (fast, slow)).withColumn("close", F.col(f"ema_{fast}") - F.col(f"ema_{slow}"))
    return both.select("symbol", "day", F.col("close").alias("macd")).join(
        ema(both.select("symbol", "day", "close"), (signal,)).withColumnRenamed(f"ema_{signal}", "signal"), ["symbol", "day"]
    )


def drawdown(returns: DataFrame) -> DataFrame:
    """(symbol, max_drawdown) of the exact growth curve, whose running peak starts at 1."""
    w = _by("symbol").rowsBetween(Window.unboundedPreceding, 0)
    level = returns.select("symbol", "day", F.sum("ret").over(w).alias("level"))
    peak = F.greatest(F.max("level").over(w), F.lit(0.0))
    return level.select("symbol", (F.exp(F.col("level") - peak) - 1).alias("dd")).groupBy("symbol").agg(F.min("dd").alias("max_drawdown"))


def performance(returns: DataFrame) -> DataFrame:
    """(symbol, sortino, calmar, hit_rate)."""
    base = returns.groupBy("symbol").agg(
        F.avg("ret").alias("mean"),
        F.sqrt(F.avg(F.pow(F.least(F.col("ret"), F.lit(0.0)), F.lit(2)))).alias("down"),
        F.avg((F.col("ret") > 0).cast("double")).alias("hit_rate"),
    )
    return base.join(drawdown(returns), "symbol").select(
        "symbol",
        (ratio(F.col("mean"), F.col("down")) * math.sqrt(YEAR)).alias("sortino"),
        ratio(F.col("mean") * YEAR, F.abs("max_drawdown")).alias("calmar"),
        "hit_rate",
    )


def quantiles(rows: DataFrame, key: str, column: str, *levels: float) -> DataFrame:
    """(key, one column a level): interpolated quantiles of the known values by key, taken from sorted ranks, which spill
    where a group's values don't fit in memory."""
    known, group = rows.where(F.col(column).isNotNull()).select(key, F.col(column).alias("x")), Window.partitionBy(key)
    ranked = known.select(key, "x", (F.row_number().over(group.orderBy("x")) - 1).alias("at"), F.count(F.lit(1)).over(group).alias("n"))

    def taken(level: float) -> Column:
        place = (F.col("n") - 1) * F.lit(level)
        low, part = F.floor(place), place - F.floor(place)
        weight = F.when(F.col("at") == low, 1 - part).when((F.col("at") == low + 1) & (part > 0), part)
        return F.sum(F.col("x") * weight)

    return ranked.groupBy(key).agg(*[taken(level).alias(f"q{k}") for k, level in enumerate(levels)])


def value_at_risk(returns: DataFrame, level: float = 0.05) -> DataFrame:
    """(symbol, var, cvar): the interpolated quantile of returns and the mean of those not above it."""
    cut = quantiles(returns, "symbol", "ret", level).toDF("symbol", "var")
    return returns.join(cut, "symbol").where(F.col("ret") <= F.col("var")).groupBy("symbol").agg(F.first("var").alias("var"), F.avg("ret").alias("cvar"))


def momentum(closes: DataFrame, far: int = 60, near: int = 5) -> DataFrame:
    """(symbol, day, momentum): return from ``far`` to ``near`` bars ago."""
    w = _by("symbol")
    return closes.select("symbol", "day", (ratio(F.lag("close", near).over(w), F.lag("close", far).over(w)) - 1).alias("momentum")).where("momentum is not null")


def quintiles(factors: DataFrame, column: str = "momentum", buckets: int = 5) -> DataFrame:
    """(symbol, day, bucket, zscore) of a factor within each day."""
    day = Window.partitionBy("day")
    z = ratio(F.col(column) - F.avg(column).over(day), F.stddev_samp(column).over(day))
    return factors.select("symbol", "day", F.ntile(buckets).over(day.orderBy(column, "symbol")).alias("bucket"), z.alias("zscore"))


def information_coefficient(factors: DataFrame, column: str = "factor", forward: str = "fwd") -> DataFrame:
    """(day, n, ic): rank correlation of a factor with the forward return, ties sharing their mean rank."""

    def mean_rank(c: str) -> Column:
        return F.rank().over(Window.partitionBy("day").orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("day", c)) - 1) / 2

    ranked = factors.where(F.col(column).isNotNull() & F.col(forward).isNotNull()).select("day", mean_rank(column).alias("x"), mean_rank(forward).alias("y"))
    return ranked.groupBy("day").agg(F.count(F.lit(1)).alias("n"), _pearson(F.col("x"), F.col("y"), lambda c: c).alias("ic"))


def turnover(weights: DataFrame) -> DataFrame:
    """(day, turnover): two-way sum of weight changes from one rebalance day to the next; absent symbols weigh 0.

    Each row of (day, symbol, weight) states its change against the symbol's row of the rebalance before, and an exit is booked on
    the rebalance after a symbol's last row, so that no weight table is multiplied out.
    """
    days = weights.select("day").distinct().withColumn("k", F.row_number().over(Window.orderBy("day")))
    numbered = weights.join(days, "day")
    w = Window.partitionBy("symbol").orderBy("k")
    before = F.when(F.lag("k").over(w) == F.col("k") - 1, F.lag("weight").over(w)).otherwise(F.lit(0.0))
    leaves = F.coalesce(F.lead("k").over(w), F.lit(-1)) != F.col("k") + 1
    changes = numbered.select("k", F.abs(F.col("weight") - before).alias("change"), F.when(leaves, F.abs("weight")).alias("exit"))
    entries = changes.select("k", "change")
    exits = changes.where("exit is not null").select((F.col("k") + 1).alias("k"), F.col("exit").alias("change"))
    return entries.unionByName(exits).groupBy("k").agg(F.sum("change").alias("turnover")).join(days, "k").select("day", "turnover")


def net_returns(gross: DataFrame, one_way_bps: float) -> DataFrame:
    """Adds net = gross - turnover * one-way cost to (gross, turnover)."""
    return gross.withColumn("net", F.col("gross") - F.col("turnover") * one_way_bps / 10_000.0)



def forward_fill(calendar: DataFrame, closes: DataFrame) -> DataFrame:
    """(symbol, day, close) on every day of ``calendar`` from a symbol's first close on, gaps taking the last one before.

    The calendar, one value a day, is one array; each symbol takes its part of it. One sorted stream by symbol follows; the grid
    has one row per symbol and calendar day, as the result does.
    """
    days = calendar.agg(F.array_sort(F.collect_set("day"))).scalar()
    spans = closes.groupBy("symbol").agg(F.min("day").alias("from")).withColumn("days", days)
    grid = spans.select("symbol", F.explode(F.filter("days", lambda d: d >= F.col("from"))).alias("day"))
    both = grid.unionByName(closes.select("symbol", "day", "close"), allowMissingColumns=True)
    merged = both.groupBy("symbol", "day").agg(F.max("close").alias("close"))
    w = _by("symbol").rowsBetween(Window.unboundedPreceding, 0)
    return merged.select("symbol", "day", F.last("close", ignorenulls=True).over(w).alias("close"))


def forward_returns(closes: DataFrame, ahead: int = 20) -> DataFrame:
    """(symbol, day, fwd): simple return over the next ``ahead`` bars, a label that must never be a feature."""
    return closes.select("symbol", "day", (ratio(F.lead("close", ahead).over(_by("symbol")), F.col("close")) - 1).alias("fwd")).where("fwd is not null")


def channels(closes: DataFrame, n: int = 20) -> DataFrame:
    """(symbol, day, upper, lower, breakout): extremes of the n bars before this one, and 1, -1 or 0 for a close beyond them."""
    w = _by("symbol").rowsBetween(-n, -1)
    full = F.count("close").over(w) >= n
    upper, lower = F.when(full, F.max("close").over(w)), F.when(full, F.min("close").over(w))
    held = closes.select("symbol", "day", "close", upper.alias("upper"), lower.alias("lower"))
    out = F.when(F.col("close") > F.col("upper"), 1).when(F.col("close") < F.col("lower"), -1).otherwise(0)
    return held.select("symbol", "day", "upper", "lower", out.alias("breakout"))


def winsorised(factors: DataFrame, column: str = "factor", low: float = 0.01, high: float = 0.99) -> DataFrame:
    """(symbol, day, clipped, zscore): a factor clipped at its day's quantiles, then standardised within the day."""
    cuts = quantiles(factors, "day", column, low, high).toDF("day", "__l", "__h")
    clipped = factors.join(cuts, "day").select("symbol", "day", F.greatest(F.least(F.col(column), F.col("__h")), F.col("__l")).alias("clipped"))
    day = Window.partitionBy("day")
    return clipped.withColumn("zscore", ratio(F.col("clipped") - F.avg("clipped").over(day), F.stddev_samp("clipped").over(day)))


def inverse_vol_weights(returns: DataFrame, window: int = 20) -> DataFrame:
    """(symbol, day, weight): shares of 1 / volatility among the symbols of a day whose window is full."""
    inverse = rolling_vol(returns, window).where("vol > 0").withColumn("__i", 1 / F.col("vol"))
    return inverse.select("symbol", "day", (F.col("__i") / F.sum("__i").over(Window.partitionBy("day"))).alias("weight"))
