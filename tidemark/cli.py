"""Command line: ``python -m tidemark download --symbol AAPL``."""

from __future__ import annotations

import argparse
import datetime as dt

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.schema import Frequency
from .functions.settings import configure_logging
from .sources import providers
from .sources.ingest import Ingest, Series
from .sources.store import BarStore


def parser() -> argparse.ArgumentParser:
    today = dt.datetime.now(dt.UTC)
    out = argparse.ArgumentParser("tidemark")
    download = out.add_subparsers(dest="command", required=True).add_parser("download", help="fetch the bars of one symbol")
    download.add_argument("--provider", choices=("yfinance", "ccxt", "tushare"), default="yfinance")
    download.add_argument("--exchange", default="binance", help="for ccxt")
    download.add_argument("--symbol", required=True)
    download.add_argument("--start", default=(today - dt.timedelta(days=365)).strftime("%Y-%m-%d"))
    download.add_argument("--end", default=today.strftime("%Y-%m-%d"))
    download.add_argument("--frequency", choices=[f.value for f in Frequency], default=Frequency.DAILY.value)
    download.add_argument("--force", action="store_true")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None, provider=None) -> None:
    args = parser().parse_args(argv)
    configure_logging()
    spark = spark or SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    made = {
        "yfinance": lambda: providers.YahooSource(spark),
        "ccxt": lambda: providers.CCXTSource(spark, args.exchange),
        "tushare": lambda: providers.TushareSource(spark),
    }
    source = provider or made[args.provider]()
    start, end = (dt.datetime.strptime(x, "%Y-%m-%d").replace(tzinfo=dt.UTC) for x in (args.start, args.end))
    bars = Ingest(source, BarStore(spark)).series(Series(args.symbol, start, end, Frequency(args.frequency)), force=args.force)
    n, first, last = bars.agg(F.count(F.lit(1)), F.min("timestamp"), F.max("timestamp")).first()
    print(f"{n} rows for {args.symbol} [{source.name}, {args.frequency}]\n   range: {first} -> {last}")
    bars.orderBy("timestamp").limit(5).show(truncate=False)
