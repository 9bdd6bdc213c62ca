"""Vendors' frames in canonical form: one function per vendor layout, all projections but for one window. Times are instants;
those that a vendor gives without a zone are in UTC, whatever the session's zone is."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.schema import OHLCV

#: Yahoo's column names.
YAHOO = {
    "Open": "open", "High": "high", "Low": "low", "Close": "close", "Volume": "volume",
    "Adj Close": "adjusted_close", "Dividends": "dividends", "Stock Splits": "stock_splits",
}


def utc(value: dt.datetime | dt.date | str) -> dt.datetime:
    """The instant meant: times with a zone keep it, others are in UTC."""
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value)
    if not isinstance(value, dt.datetime):
        value = dt.datetime(value.year, value.month, value.day)
    return value.replace(tzinfo=dt.UTC) if value.tzinfo is None else value.astimezone(dt.UTC)


def utc_millis(value: dt.datetime | dt.date | str) -> int:
    return (utc(value) - dt.datetime(1970, 1, 1, tzinfo=dt.UTC)) // dt.timedelta(milliseconds=1)


def _instant(time: Column, kind: T.DataType) -> Column:
    """A column of instants, or of days or wall-clock times in UTC, as instants."""
    if isinstance(kind, T.TimestampType):
        return time
    if isinstance(kind, T.DateType):
        return F.timestamp_seconds(F.unix_date(time) * 86_400)
    wall = time.cast(T.TimestampNTZType())
    parts = [f(wall) for f in (F.year, F.month, F.day, F.hour, F.minute)]
    return F.make_timestamp(*parts, F.extract(F.lit("SECOND"), wall), F.lit("UTC"))


def from_yahoo(raw: DataFrame) -> DataFrame:
    """Datetime, else Date, becomes the timestamp in UTC; canonical columns first, all others after; rows with a gap go."""
    time = "Datetime" if "Datetime" in raw.columns else "Date"
    named = raw.withColumnsRenamed({k: v for k, v in (YAHOO | {time: "timestamp"}).items() if k in raw.columns})
    named = named.withColumn("timestamp", _instant(F.col("timestamp"), named.schema["timestamp"].dataType))
    return named.select(*OHLCV, *[c for c in named.columns if c not in OHLCV]).na.drop(subset=list(OHLCV))


def from_ccxt(raw: DataFrame, end: dt.datetime | dt.date | str, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(ms, open .. volume, arrival): bars up to and with ``end``, the first arrival of each time, in order of time. The bound
    is compared as epoch milliseconds, so it reaches the scan."""
    keys = tuple(k for k in keys if k in raw.columns)
    held = raw.where(F.col("ms") <= utc_millis(end))
    first = F.row_number().over(Window.partitionBy(*keys, "ms").orderBy("arrival"))
    kept = held.withColumn("__k", first).where("__k = 1").withColumn("timestamp", F.timestamp_millis("ms"))
    return kept.select(*keys, *OHLCV).sort(*keys, "timestamp")


def from_tushare(raw: DataFrame) -> DataFrame:
    """yyyyMMdd days in UTC, vol for volume, amount kept, values unscaled; in order of time."""
    timed = raw.withColumnsRenamed({"trade_date": "timestamp", "vol": "volume"})
    day = F.to_date(F.col("timestamp").cast("string"), "yyyyMMdd")
    return timed.withColumn("timestamp", _instant(day, T.DateType())).select(*OHLCV, "amount").sort("timestamp")


def keep_first(rows: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """The first arrival of each key; which one survives is defined, unlike with dropDuplicates."""
    return rows.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(arrival))).where("__k = 1").drop("__k")
