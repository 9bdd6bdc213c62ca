"""Network sources. Each needs its vendor's client library, imported on first use; what they return is normalised in Spark."""

from __future__ import annotations

import importlib
import os
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.errors import AuthenticationError, DataProviderError
from ..functions.scalars import EXCHANGES
from ..functions.schema import VENDOR_FREQUENCY, Frequency, Market
from . import normalise
from .ingest import BarSource, Series


def client(name: str):
    try:
        return importlib.import_module(name)
    except ModuleNotFoundError as error:
        raise DataProviderError(f"the {name} package is needed for this source") from error


class YahooSource(BarSource):
    name = "yfinance"
    markets = frozenset({Market.US, Market.CRYPTO, Market.HK})
    frequencies = frozenset(map(Frequency, VENDOR_FREQUENCY["yfinance"]))

    def __init__(self, spark: SparkSession, history: Callable[..., pd.DataFrame] | None = None):
        self.spark, self.history = spark, history

    def bars(self, series: Series) -> DataFrame:
        interval = VENDOR_FREQUENCY["yfinance"].get(series.frequency)
        if interval is None:
            raise DataProviderError(f"unsupported frequency: {series.frequency}")
        ask = self.history or (lambda symbol, **how: client("yfinance").Ticker(symbol).history(**how))
        try:
            raw = ask(series.symbol, start=series.start, end=series.end, interval=interval, auto_adjust=False, actions=True)
        except DataProviderError:
            raise
        except Exception as error:
            raise DataProviderError(f"yfinance failed: {error}") from error
        if raw.empty:
            raise DataProviderError(f"yfinance returned nothing for {series.symbol}")
        raw = raw.reset_index()
        column = "Datetime" if "Datetime" in raw else "Date"
        raw[column] = pd.to_datetime(raw[column], utc=True)
        raw["arrival"] = range(len(raw))
        return normalise.from_yahoo(self.spark.createDataFrame(raw))


class CCXTSource(BarSource):
    """Pages of candles: the cursor moves past the last one, until a page is empty or short or the cursor stands still."""

    markets = frozenset({Market.CRYPTO})
    frequencies = frozenset(Frequency)

    def __init__(self, spark: SparkSession, exchange: str = "binance", page: int = 1000, candles: Callable[..., list] | None = None):
        self.spark, self.page, self.name = spark, page, f"ccxt.{exchange}"
        if candles is None:
            library = client("ccxt")
            if not hasattr(library, exchange):
                raise DataProviderError(f"unknown exchange: {exchange}")
            candles = getattr(library, exchange)({"enableRateLimit": True}).fetch_ohlcv
        self.candles = candles

    def bars(self, series: Series) -> DataFrame:
        since, end = (normalise.utc_millis(t) for t in (series.start, series.end))
        rows: list[list] = []
        while since < end:
            try:
                found = self.candles(series.symbol, timeframe=str(series.frequency), since=since, limit=self.page)
            except Exception as error:
                raise DataProviderError(f"{self.name} failed: {error}") from error
            if not found or (rows and found[-1][0] <= rows[-1][0]):
                break
            rows += found
            since = found[-1][0] + 1
            if len(found) < self.page:
                break
        if not rows:
            raise DataProviderError(f"{self.name} returned nothing for {series.symbol}")
        shaped = [(int(r[0]), *map(float, r[1:6]), k) for k, r in enumerate(rows)]
        raw = self.spark.createDataFrame(shaped, "ms long, open double, high double, low double, close double, volume double, arrival long")
        return normalise.from_ccxt(raw, series.end)


class TushareSource(BarSource):
    name = "tushare"
    markets = frozenset({Market.CN})
    frequencies = frozenset({Frequency.DAILY, Frequency.WEEKLY, Frequency.MONTHLY})
    needs_token = True

    def __init__(self, spark: SparkSession, daily: Callable[..., pd.DataFrame] | None = None):
        self.spark, self.daily = spark, daily
        if daily is None and not os.environ.get("TUSHARE_TOKEN"):
            raise AuthenticationError("TUSHARE_TOKEN isn't set")

    @staticmethod
    def code(symbol: str) -> str:
        if "." in symbol:
            return symbol.upper()
        for suffix, prefixes in EXCHANGES.items():
            if symbol.startswith(prefixes):
                return symbol + suffix
        raise ValueError(f"cannot infer the exchange of {symbol}")

    def bars(self, series: Series) -> DataFrame:
        if series.frequency != Frequency.DAILY:
            raise DataProviderError(f"unsupported frequency: {series.frequency}")
        code = self.code(series.symbol)
        ask = self.daily or client("tushare").pro_api(os.environ["TUSHARE_TOKEN"]).daily
        try:
            raw = ask(ts_code=code, start_date=series.start.strftime("%Y%m%d"), end_date=series.end.strftime("%Y%m%d"))
        except Exception as error:
            raise DataProviderError(f"tushare failed: {error}") from error
        if raw is None or raw.empty:
            raise DataProviderError(f"tushare returned nothing for {code}")
        return normalise.from_tushare(self.spark.createDataFrame(raw).withColumn("trade_date", F.col("trade_date").cast("string")))
