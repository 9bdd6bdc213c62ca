"""Registered queries of sources, store, rules and settings. Their results are small tables of what happened, which SQL states outright."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions.errors import AuthenticationError, DataProviderError, RateLimitError, SymbolNotFoundError, UniverseDataUnavailableError, UniverseError
from ..functions.schema import Frequency, Market
from ..functions.settings import Settings
from ..operators import costs, quality
from ..sources import bars as bar_sources
from ..sources import normalise
from ..sources.ingest import Ingest, Series, TableSource
from ..sources.providers import CCXTSource, TushareSource, YahooSource
from ..sources.store import BarStore
from .catalogue import ORDER_BARS, dated, query, read, scratch

START, END = dt.datetime(1992, 1, 1, tzinfo=dt.UTC), dt.datetime(1999, 1, 1, tzinfo=dt.UTC)


def values(names: str, *rows: tuple) -> str:
    cell = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, row)) + ')' for row in rows)}) AS t({names})"


def order_source(spark, d) -> TableSource:
    """Bars of orders by status, each day an instant in UTC."""
    held = bar_sources.order_bars(read(spark, d, "orders"))
    time = F.timestamp_seconds(F.unix_date(F.to_date("day")) * 86_400)
    return TableSource(held.select("symbol", time.alias("timestamp"), "open", "high", "low", "close", "volume"))


def wanted(*symbols: str, start=START, end=END) -> list[Series]:
    return [Series(s, start, end) for s in symbols]


def _day():
    return F.date_from_unix_date(F.floor(F.unix_seconds("timestamp") / 86_400).cast("int")).alias("day")


@query(f"SELECT symbol, day, open, high, low, close, volume FROM ({ORDER_BARS}) WHERE symbol IN ('F', 'O')")
def ingest_round_trip(spark, d):
    """Source to store and back, for two series of a batch of three that the source lacks one of."""
    ingest = Ingest(order_source(spark, d), BarStore(spark, scratch(spark, "ingest")))
    ingest.load([Series(s, dt.datetime(1900, 1, 1), dt.datetime(2100, 1, 1)) for s in ("F", "none", "O")])
    return ingest.stored(wanted("F", "O")).select("symbol", _day(), "open", "high", "low", "close", "volume")


@query(f"SELECT symbol, count(*) AS stored, count_if(day BETWEEN '1995-01-01' AND '1995-06-30') AS clipped FROM ({ORDER_BARS}) WHERE symbol = 'F' AND day <= '1996-12-31' GROUP BY symbol")
def ingest_hit_ignores_range(spark, d):
    """A series that is stored comes back whole, whatever the range asked for, or clipped on request."""
    ingest = Ingest(order_source(spark, d), BarStore(spark, scratch(spark, "hit")))
    ingest.load(wanted("F", start=dt.datetime(1900, 1, 1), end=dt.datetime(1996, 12, 31)))
    later = wanted("F", start=dt.datetime(1995, 1, 1), end=dt.datetime(1995, 6, 30))
    ingest.load(later)
    whole, part = ingest.stored(later).groupBy("symbol").agg(F.count(F.lit(1)).alias("stored")), ingest.stored(later, clip=True)
    return whole.join(part.groupBy("symbol").agg(F.count(F.lit(1)).alias("clipped")), "symbol")


@query(values("run, symbol, fetched, error_kind, error", (1, "F", True, None, None), (1, "none", False, "DataProviderError", "no bars of none"), (1, "O", True, None, None),
              (2, "F", False, None, None), (2, "P", True, None, None), (3, "none", False, "DataProviderError", "no bars of none"), (4, "F", True, None, None)))
def ingest_outcomes(spark, d):
    """What each series of a batch came to: fetched, already stored, the source's error, an end by the first error, and by force."""
    ingest = Ingest(order_source(spark, d), BarStore(spark, scratch(spark, "outcomes")))
    far = {"start": dt.datetime(1900, 1, 1), "end": dt.datetime(2100, 1, 1)}
    runs = [ingest.load(wanted("F", "none", "O", **far)), ingest.load(wanted("F", "P", **far)), ingest.load(wanted("none", "X", **far), stop_on_error=True), ingest.load(wanted("F", **far), force=True)]
    out = None
    for k, found in enumerate(runs, 1):
        one = found.select(F.lit(k).alias("run"), "symbol", "fetched", "error_kind", "error")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""SELECT symbol, 'table' AS provider, '1d' AS frequency, '1' AS schema_version, count(*)::VARCHAR AS row_count, strftime(min(day), '%Y-%m-%dT00:00:00+00:00') AS first,
    strftime(max(day), '%Y-%m-%dT00:00:00+00:00') AS last, 'orders' AS note FROM ({ORDER_BARS}) GROUP BY symbol""")
def store_provenance(spark, d):
    """The provenance of a batch, with an entry of the caller's."""
    store = BarStore(spark, scratch(spark, "provenance"))
    store.write_many(order_source(spark, d).rows.withColumn("frequency", F.lit("1d")), "table", extra={"note": "orders"})
    entry = lambda name: F.col("entries")[name]
    return store.metadata().select(*(entry(c).alias(c) for c in ("symbol", "provider", "frequency", "schema_version", "row_count")), entry("start").alias("first"), entry("end").alias("last"), entry("note").alias("note"))


@query("""SELECT s AS symbol, translate(s, '/:\\', '---') AS safe, CASE WHEN regexp_matches(s, '^[A-Za-z0-9._-]*$') THEN s
    ELSE regexp_replace(s, '[^A-Za-z0-9._-]', '-', 'g') || '~' || substr(sha256(s), 1, 12) END AS folder, s IN ('A/B', 'A-B') AS there
    FROM (SELECT unnest(['AAPL', 'A/B', 'A-B', 'A:B', 'BTC/USDT:USDT', 'ES=F', 'x\\y', 'a b']) AS s)""")
def store_folders(spark, d):
    """Safe names, which may be one for several symbols, the folders, which aren't, and which of them hold bars."""
    store = BarStore(spark, scratch(spark, "folders"))
    one = order_source(spark, d).rows.where("symbol = 'F'").limit(5).cache()
    for symbol in ("A/B", "A-B"):
        store.write(one.drop("symbol"), "table", symbol, "1d")
    names = ["AAPL", "A/B", "A-B", "A:B", "BTC/USDT:USDT", "ES=F", "x\\y", "a b"]
    return spark.createDataFrame([(s, store.safe(s), store.folder(s), store.exists("table", s, "1d")) for s in names], "symbol string, safe string, folder string, there boolean")


@query(f"SELECT symbol, day, open, high, low, close, volume, close * 0.5 AS adjusted_close FROM ({ORDER_BARS}) WHERE dayofyear(day) % 11 <> 0")
def yahoo_layout(spark, d):
    """A Yahoo-like frame with days and gaps, in canonical form."""
    held = dated(bar_sources.order_bars(read(spark, d, "orders")))
    named = held.select("symbol", F.col("day").alias("Date"), F.col("open").alias("Open"), F.when(F.dayofyear("day") % 11 != 0, F.col("high")).alias("High"),
                        F.col("low").alias("Low"), F.col("close").alias("Close"), F.col("volume").alias("Volume"), (F.col("close") * 0.5).alias("Adj Close"))
    return normalise.from_yahoo(named).select("symbol", _day(), "open", "high", "low", "close", "volume", "adjusted_close")


@query(f"SELECT day, open, high, low, close, volume, close * 2 AS amount FROM ({ORDER_BARS}) WHERE symbol = 'F'")
def tushare_layout(spark, d):
    """A Tushare-like frame with yyyyMMdd days, in canonical form."""
    held = dated(bar_sources.order_bars(read(spark, d, "orders"))).where("symbol = 'F'")
    named = held.select(F.date_format("day", "yyyyMMdd").alias("trade_date"), "open", "high", "low", "close", F.col("volume").alias("vol"), (F.col("close") * 2).alias("amount"))
    return normalise.from_tushare(named).select(_day(), "open", "high", "low", "close", "volume", "amount")


@query(f"SELECT day, open, high, low, close, volume FROM ({ORDER_BARS}) WHERE symbol = 'F' ORDER BY day LIMIT 5")
def head_of_bars(spark, d):
    """The first five bars of a series by time, as the command line shows them."""
    return order_source(spark, d).bars(wanted("F", start=dt.datetime(1900, 1, 1), end=dt.datetime(2100, 1, 1))[0]).orderBy("timestamp").limit(5).select(_day(), "open", "high", "low", "close", "volume")


@query("""SELECT l_returnflag AS symbol, count_if(quantity > 0 AND price > 0) AS valid, count_if(NOT (quantity > 0 AND price > 0)) AS invalid
    FROM (SELECT l_returnflag, l_quantity - 3 AS quantity, l_extendedprice - 2000 AS price FROM lineitem) GROUP BY l_returnflag""")
def valid_trades(spark, d):
    """Trades with a quantity and price above 0."""
    trades = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("symbol"), (F.col("l_quantity") - 3).alias("quantity"), (F.col("l_extendedprice") - 2000).alias("price"))
    return trades.groupBy("symbol").agg(F.count_if(costs.valid_trade()).alias("valid"), F.count_if(~costs.valid_trade()).alias("invalid"))


def _raised(action) -> tuple[str, str]:
    try:
        action()
    except Exception as error:
        return type(error).__name__, str(error)
    return "", ""


@query(values("rule, kind, message", ("V1", "ValueError", "OHLCV DataFrame is empty"), ("V1 first", "ValueError", "OHLCV DataFrame is empty"), ("V2", "ValueError", "OHLCV DataFrame missing columns: ['close', 'volume']"),
              ("V3", "TypeError", "`timestamp` column must be datetime64"), ("V4", "TypeError", "`close` must be numeric, got string"), ("V5", "ValueError", "`timestamp` must be monotonically increasing"),
              ("V6", "ValueError", "`timestamp` contains duplicates"), ("fine", "", "")))
def bar_errors(spark, d):
    """The error that each broken table of bars raises."""
    good = order_source(spark, d).rows.where("symbol = 'F'").drop("symbol")
    order = F.unix_seconds("timestamp")
    cases = {
        "V1": lambda: quality.validate(good.limit(0)),
        "V1 first": lambda: quality.validate(good.limit(0).drop("close")),
        "V2": lambda: quality.validate(good.drop("close", "volume")),
        "V3": lambda: quality.validate(good.withColumn("timestamp", F.col("timestamp").cast("string"))),
        "V4": lambda: quality.validate(good.withColumn("close", F.col("close").cast("string"))),
        "V5": lambda: quality.validate(good.withColumn("arrival", -order), sequence="arrival"),
        "V6": lambda: quality.validate(good.union(good.limit(1))),
        "fine": lambda: quality.validate(good.withColumn("arrival", order), sequence="arrival"),
    }
    return spark.createDataFrame([(name, *_raised(case)) for name, case in cases.items()], "rule string, kind string, message string")


@query(values("model, message", ("FixedBps", "FixedBps.bps must be >= 0, got -1"), ("HalfSpread", "HalfSpread.spread_bps must be >= 0, got -1"), ("SquareRootImpact", "SquareRootImpact.adv must be > 0, got 0"),
              ("Futures mode", "Futures.mode must be per_contract or bps, got other"), ("Futures", "Futures.commission_bps must be >= 0, got -0.5"), ("component", "commission must be >= 0, got -1.0")))
def cost_errors(spark, d):
    """The errors of parameters and of a model whose component is negative."""

    class Rebate(costs.CostModel):
        def parts(self):
            return {"commission": F.lit(-1.0)}

    def component():
        try:
            Rebate().estimate(costs.reference_trades(spark)).collect()
        except Exception as error:
            raise ValueError(str(error).split("] ")[-1].split(" SQLSTATE")[0].strip()) from None

    cases = {
        "FixedBps": lambda: costs.FixedBps(-1), "HalfSpread": lambda: costs.HalfSpread(-1), "SquareRootImpact": lambda: costs.SquareRootImpact(adv=0),
        "Futures mode": lambda: costs.Futures(mode="other"), "Futures": lambda: costs.Futures(commission_bps=-0.5), "component": component,
    }
    return spark.createDataFrame([(name, _raised(case)[1]) for name, case in cases.items()], "model string, message string")


@query(values("source, frequency, market, offered", *[
    (name, str(f), m, f in fs and (m is None or m in ms))
    for name, fs, ms in (("yfinance", "1m 5m 15m 30m 1h 1d 1w 1M".split(), "us crypto hk".split()), ("ccxt.binance", "1m 5m 15m 30m 1h 4h 1d 1w 1M".split(), ["crypto"]), ("tushare", "1d 1w 1M".split(), ["cn"]))
    for f in "1m 5m 15m 30m 1h 4h 1d 1w 1M".split() for m in (None, "cn", "us", "crypto", "futures_cn", "hk")]))
def source_offers(spark, d):
    """Which source offers which frequency in which market."""
    sources = [YahooSource(spark, lambda *a, **k: None), CCXTSource(spark, candles=lambda *a, **k: []), TushareSource(spark, lambda **k: None)]
    rows = [
        (s.name, str(f), None if m is None else str(m), s.offers(Series("X", START, END, f, m))) for s in sources for f in Frequency for m in (None, *Market)
    ]
    return spark.createDataFrame(rows, "source string, frequency string, market string, offered boolean")


@query(values("error, parent", ("AuthenticationError", "DataProviderError"), ("SymbolNotFoundError", "DataProviderError"), ("RateLimitError", "DataProviderError"), ("UniverseDataUnavailableError", "UniverseError"),
              ("DataProviderError", "Exception"), ("UniverseError", "Exception")))
def error_kinds(spark, d):
    kinds = (AuthenticationError, SymbolNotFoundError, RateLimitError, UniverseDataUnavailableError, DataProviderError, UniverseError)
    return spark.createDataFrame([(k.__name__, k.__bases__[0].__name__) for k in kinds], "error string, parent string")


@query(values("folder, below", ("raw", "/raw"), ("processed", "/processed"), ("cache", "/cache")))
def data_folders(spark, d):
    """The folders below the data root."""
    held = Settings(spark)
    return spark.createDataFrame([(name, getattr(held, name).removeprefix(held.root)) for name in ("raw", "processed", "cache")], "folder string, below string")


@query(f"""SELECT day, open, close FROM (SELECT *, row_number() OVER (ORDER BY day) AS k FROM ({ORDER_BARS}) WHERE symbol = 'F' AND day BETWEEN '1994-01-01' AND '1995-01-01') WHERE day <= '1995-01-01'""")
def paged_candles(spark, d):
    """Candles fetched page by page until a page is short or the end is passed."""
    rows = [(r.ms, r.open, r.high, r.low, r.close, r.volume) for r in order_source(spark, d).bars(wanted("F", start=dt.datetime(1994, 1, 1), end=dt.datetime(1996, 1, 1))[0]).select(F.unix_millis("timestamp").alias("ms"), "open", "high", "low", "close", "volume").orderBy("ms").collect()]

    def page(symbol, timeframe, since, limit):
        return [list(r) for r in rows if r[0] >= since][:limit]

    found = CCXTSource(spark, page=100, candles=page).bars(Series("F", dt.datetime(1994, 1, 1), dt.datetime(1995, 1, 1)))
    return found.select(_day(), "open", "close")
