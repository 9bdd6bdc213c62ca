"""Data-quality rules of bars, counted in one aggregation per symbol and raised in a fixed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import known, missing
from ..functions.schema import OHLCV, PRICES

#: Rules in the order in which they are raised. The texts that callers match on.
MESSAGES = {
    "not_monotonic": "`timestamp` must be monotonically increasing",
    "duplicate_timestamps": "`timestamp` contains duplicates",
    "missing_values": "OHLCV contains NaN (pass allow_nan=True to permit)",
    "high_below_low": "Found rows where high < low",
    "high_below_body": "Found rows where high < open or high < close",
    "low_above_body": "Found rows where low > open or low > close",
    "negative_volume": "Found negative volume",
}


EMPTY = "OHLCV DataFrame is empty"


def check_schema(bars: DataFrame) -> None:
    """Columns and types, without a job."""
    absent = sorted(set(OHLCV) - set(bars.columns))
    if absent:
        raise ValueError(f"OHLCV DataFrame missing columns: {absent}")
    if not isinstance(bars.schema["timestamp"].dataType, (T.TimestampType, T.TimestampNTZType)):
        raise TypeError("`timestamp` column must be datetime64")
    for c in PRICES:
        if not isinstance(bars.schema[c].dataType, T.NumericType):
            raise TypeError(f"`{c}` must be numeric, got {bars.schema[c].dataType.simpleString()}")


def row_rules() -> dict[str, Column]:
    """Rules that one row decides; a comparison with a null or NaN is false."""
    o, h, lo, c, v = (F.col(x) for x in PRICES)
    gap = missing(o)
    for x in (h, lo, c, v):
        gap = gap | missing(x)
    return {
        "missing_values": gap,
        "high_below_low": known(h < lo, h, lo),
        "high_below_body": known(h < o, h, o) | known(h < c, h, c),
        "low_above_body": known(lo > o, lo, o) | known(lo > c, lo, c),
        "negative_volume": known(v < 0, v),
    }


def violations(bars: DataFrame, keys: tuple[str, ...] = (), sequence: str | None = None) -> DataFrame:
    """Rows and violations of each rule, by ``keys``.

    Rows have no order in Spark: monotonicity is judged along ``sequence``, the order of arrival, and without it only null
    timestamps break it. A timestamp's second and later rows count as duplicates.
    """
    check_schema(bars)
    same = bars
    if sequence:
        before = F.lag("timestamp").over(Window.partitionBy(*keys).orderBy(sequence))
        same = same.withColumn("__back", F.coalesce(before > F.col("timestamp"), F.lit(False)))
    else:
        same = same.withColumn("__back", F.lit(False))
    counts = [F.count_if(rule).alias(name) for name, rule in row_rules().items()]
    # One partial aggregation by timestamp serves duplicates, one by key the rest.
    by_time = same.groupBy(*keys, "timestamp").agg(
        F.count(F.lit(1)).alias("__n"), F.count_if(F.col("__back") | F.col("timestamp").isNull()).alias("not_monotonic"), *counts
    )
    return by_time.groupBy(*keys).agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum("not_monotonic"), F.lit(0)).alias("not_monotonic"),
        F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_timestamps"),
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in row_rules()],
    )


def validate(bars: DataFrame, allow_nan: bool = False, keys: tuple[str, ...] = (), sequence: str | None = None) -> None:
    """Raises the first violated rule: emptiness, columns, types, then MESSAGES in order."""
    if bars.isEmpty():
        raise ValueError(EMPTY)
    report = violations(bars, keys, sequence)
    worst = report.agg(F.sum("rows").alias("rows"), *[F.sum(name).alias(name) for name in MESSAGES]).first()
    for name, message in MESSAGES.items():
        if worst[name] and not (allow_nan and name == "missing_values"):
            raise ValueError(message)
