"""Names and types of bars, trades, universes and costs."""

from __future__ import annotations

from enum import StrEnum

from pyspark.sql import types as T

#: Canonical bar columns in order, and the optional ones.
OHLCV = ("timestamp", "open", "high", "low", "close", "volume")
OPTIONAL = ("adjusted_close", "dividends", "stock_splits", "amount", "turnover")
PRICES = OHLCV[1:]
KEYS = ("provider", "symbol", "frequency")
SCHEMA_VERSION = "1"

BARS = T.StructType(
    [T.StructField(k, T.StringType()) for k in KEYS]
    + [T.StructField("timestamp", T.TimestampType())]
    + [T.StructField(c, T.DoubleType()) for c in (*PRICES, *OPTIONAL)]
)
TRADES = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("side", T.StringType()), T.StructField("quantity", T.DoubleType()), T.StructField("price", T.DoubleType())]
)
SNAPSHOT = "as_of date, members array<string>, metadata map<string,string>"


class Market(StrEnum):
    """Fixed values."""

    CN = "cn"
    US = "us"
    CRYPTO = "crypto"
    FUTURES_CN = "futures_cn"
    HK = "hk"


class Frequency(StrEnum):
    """Fixed values. Case matters: 1m is a minute and 1M a month."""

    MINUTE_1 = "1m"
    MINUTE_5 = "5m"
    MINUTE_15 = "15m"
    MINUTE_30 = "30m"
    HOUR_1 = "1h"
    HOUR_4 = "4h"
    DAILY = "1d"
    WEEKLY = "1w"
    MONTHLY = "1M"

    @property
    def folder(self) -> str:
        """A partition value that stays distinct on file systems that ignore case."""
        return "1mo" if self is Frequency.MONTHLY else self.value


class Side(StrEnum):
    BUY = "buy"
    SELL = "sell"


#: vendors' names of the frequencies.
VENDOR_FREQUENCY = {
    "yfinance": {"1m": "1m", "5m": "5m", "15m": "15m", "30m": "30m", "1h": "60m", "1d": "1d", "1w": "1wk", "1M": "1mo"},
    "ccxt": {f.value: f.value for f in Frequency},
}
#: Rebalances in a year.
REBALANCES = {"daily": 252.0, "weekly": 52.0, "biweekly": 26.0, "monthly": 12.0, "quarterly": 4.0, "annual": 1.0}
