"""Universes: sets of symbols at a date.

A snapshot is one row (as_of date, members array<string> sorted and distinct, metadata map<string,string>); a membership
history is rows (effective_date date, members array<string>) of whole sets.
"""

from __future__ import annotations

import datetime as dt
import logging
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.errors import UniverseDataUnavailableError
from ..functions.scalars import as_date
from ..functions.schema import SNAPSHOT

log = logging.getLogger("tidemark")

#: Stand-in members for offline use, in the order that a cut to the first N follows.
CSI300_SEED = """
600519.SH 601318.SH 600036.SH 000858.SZ 600900.SH 601888.SH 000333.SZ 600030.SH 601166.SH 002594.SZ
600276.SH 601398.SH 601939.SH 600050.SH 601628.SH 300750.SZ 601857.SH 000001.SZ 600887.SH 601088.SH
600016.SH 000002.SZ 600000.SH 002304.SZ 600031.SH 000651.SZ 600048.SH 601668.SH 600585.SH 601012.SH
""".split()
SP500_SEED = """
AAPL MSFT NVDA GOOGL GOOG AMZN META BRK-B LLY TSLA AVGO JPM V UNH XOM WMT MA PG JNJ HD
ORCL COST MRK ABBV CVX NFLX BAC KO ADBE PEP TMO CRM CSCO MCD ABT WFC ACN LIN DHR INTU
""".split()
CRYPTO_SEED = """
BTC/USDT ETH/USDT SOL/USDT BNB/USDT XRP/USDT DOGE/USDT ADA/USDT AVAX/USDT TRX/USDT LINK/USDT
DOT/USDT MATIC/USDT LTC/USDT BCH/USDT NEAR/USDT UNI/USDT ATOM/USDT APT/USDT OP/USDT ARB/USDT
""".split()

Source = Callable[[dt.date], object]


def normalised(members: Column) -> Column:
    return F.array_sort(F.array_distinct(members))


def long_form(snapshots: DataFrame) -> DataFrame:
    """(as_of, symbol), one row per member."""
    return snapshots.select("as_of", F.explode("members").alias("symbol"))


def members_of(bars: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Bars of the snapshot's members (semi join on symbol)."""
    return bars.join(long_form(snapshot).select("symbol").distinct(), "symbol", "left_semi")


def outside(bars: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Bars of all other symbols (anti join on symbol)."""
    return bars.join(long_form(snapshot).select("symbol").distinct(), "symbol", "left_anti")


def as_of(dates: DataFrame, history: DataFrame, default: Iterable[str] = (), buckets: Column | None = None) -> DataFrame:
    """The members on each row of ``dates`` (as_of date): those of the last effective date not after it, else the default.

    One sorted pass: history and dates meet in one ordered stream in which the last set is carried forward, not in a range
    join. Equal dates are looked up once, so that the stream is as long as the calendar however many rows ask;
    ``buckets`` names a key that splits the stream where histories of many universes are held together.
    """
    key = "__u"
    of = (lambda df: df.withColumn(key, F.lit(0))) if buckets is None else (lambda df: df.withColumn(key, buckets))
    held = of(history).select(key, F.col("effective_date").alias("as_of"), F.col("effective_date").alias("effective"), normalised(F.col("members")).alias("found"))
    asked = of(dates).select(key, "as_of").distinct().select(key, "as_of", F.lit(None).cast("date").alias("effective"), F.lit(None).cast("array<string>").alias("found"))
    w = Window.partitionBy(key).orderBy("as_of", F.col("effective").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    carried = held.withColumn("asked", F.lit(False)).unionByName(asked.withColumn("asked", F.lit(True)))
    carried = carried.withColumn("found", F.last("found", ignorenulls=True).over(w)).withColumn("effective", F.last("effective", ignorenulls=True).over(w))
    fallback = normalised(F.array(*[F.lit(s) for s in default]).cast("array<string>"))
    looked = carried.where("asked").select(
        key,
        "as_of",
        F.coalesce("found", fallback).alias("members"),
        F.coalesce(F.concat(F.lit("history@"), F.col("effective").cast("string")), F.lit("default")).alias("source"),
    )
    return of(dates).join(looked, [key, "as_of"]).drop(key)


def top_n(tickers: DataFrame, n: int, quote: str = "USDT", anchors: Iterable[str] = ()) -> DataFrame:
    """(symbol): the n largest (symbol, quote_volume) that are quoted in ``quote``, and the anchors that are.

    Null, NaN and negative volumes don't count; ties go by symbol; anchors need no ticker.
    """
    if n <= 0:
        raise ValueError(f"top_n must be > 0, got {n}")
    volume = F.col("quote_volume")
    fits = F.endswith("symbol", F.lit(f"/{quote}")) & volume.isNotNull() & ~F.isnan(volume.cast("double")) & (volume >= 0)
    best = tickers.where(fits).orderBy(F.desc("quote_volume"), F.asc("symbol")).limit(n).select("symbol")
    kept = [(a,) for a in dict.fromkeys(anchors) if a.endswith(f"/{quote}")]
    return best.union(tickers.sparkSession.createDataFrame(kept, "symbol string")).distinct()


def churn(history: DataFrame) -> DataFrame:
    """Members that joined and left at each effective date (extension)."""
    before = F.coalesce(F.lag("members").over(Window.orderBy("effective_date")), F.array().cast("array<string>"))
    sets = history.select("effective_date", normalised(F.col("members")).alias("members"))
    return sets.select(
        "effective_date",
        F.array_sort(F.array_except("members", before)).alias("joined"),
        F.array_sort(F.array_except(before, F.col("members"))).alias("left"),
    )


@dataclass
class Universe:
    """A builder of snapshots. Subclasses give ``select``."""

    spark: SparkSession
    name: str = "universe"

    def snapshot(self, at: dt.date | dt.datetime | None = None) -> DataFrame:
        raise NotImplementedError

    def members(self, at: dt.date | dt.datetime | None = None) -> set[str]:
        return set(self.snapshot(at).first()["members"])

    def _snapshot(self, at: dt.date, members: Iterable[str], **metadata: object) -> DataFrame:
        row = (at, sorted(set(members)), {k: str(v) for k, v in {"builder": self.name, **metadata}.items()})
        return self.spark.createDataFrame([row], SNAPSHOT)


@dataclass
class StaticUniverse(Universe):
    """A fixed list, or whole sets by effective date."""

    members_list: tuple[str, ...] = ()
    history: dict[dt.date, tuple[str, ...]] = field(default_factory=dict)
    name: str = "static"

    def snapshot(self, at: dt.date | dt.datetime | None = None) -> DataFrame:
        dates = self.spark.createDataFrame([(as_date(at),)], "as_of date")
        held = self.spark.createDataFrame([(d, list(m)) for d, m in self.history.items()], "effective_date date, members array<string>")
        found = as_of(dates, held, self.members_list)
        return found.select("as_of", "members", F.create_map(F.lit("builder"), F.lit(self.name), F.lit("source"), F.col("source")).alias("metadata"))


@dataclass
class SeededUniverse(Universe):
    """Members from a source, a seed list where it is missing, fails or is empty (or an error, if the seed isn't allowed).

    The seed takes no account of the date; ``source`` in the metadata tells.
    """

    source: Source | None = None
    use_seed_on_error: bool = True
    seed: tuple[str, ...] = ()
    label: str = "fetcher"

    def snapshot(self, at: dt.date | dt.datetime | None = None) -> DataFrame:
        day = as_date(at)
        if self.source is None:
            return self._seeded(day, f"no {self.label} configured")
        try:
            found = self.source(day)
            empty = not self._some(found)
        except Exception as error:  # a source is foreign code
            if not self.use_seed_on_error:
                raise UniverseDataUnavailableError(f"{self.name}: {self.label} failed: {error}") from error
            log.warning("%s: %s failed (%s); the seed is used", self.name, self.label, error)
            return self._seeded(day, f"{self.label} error: {error}")
        if empty:
            if not self.use_seed_on_error:
                raise UniverseDataUnavailableError(f"{self.name}: {self.label} returned empty")
            return self._seeded(day, f"{self.label} returned empty")
        return self._found(day, found)

    @staticmethod
    def _some(found: object) -> bool:
        return not found.isEmpty() if isinstance(found, DataFrame) else bool(found)

    def _seeded(self, day: dt.date, reason: str) -> DataFrame:
        return self._snapshot(day, self.seed, source="seed", reason=reason)

    def _found(self, day: dt.date, found: object) -> DataFrame:
        """A source gives a list of symbols or a DataFrame (symbol)."""
        if not isinstance(found, DataFrame):
            return self._snapshot(day, found, source=self.label)
        return found.agg(F.array_sort(F.collect_set("symbol")).alias("members")).select(
            F.lit(day).alias("as_of"), "members", F.create_map(F.lit("builder"), F.lit(self.name), F.lit("source"), F.lit(self.label)).alias("metadata")
        )


def csi300(spark: SparkSession, fetcher: Source | None = None, use_seed_on_error: bool = True, seed: Iterable[str] = CSI300_SEED) -> SeededUniverse:
    return SeededUniverse(spark, "csi300", fetcher, use_seed_on_error, tuple(seed))


def sp500(spark: SparkSession, fetcher: Source | None = None, use_seed_on_error: bool = True, seed: Iterable[str] = SP500_SEED) -> SeededUniverse:
    return SeededUniverse(spark, "sp500", fetcher, use_seed_on_error, tuple(seed))


@dataclass
class CryptoTopN(SeededUniverse):
    """The top symbols by quote volume and the anchors; the first of the seed list, as they are, without a source."""

    name: str = "crypto_topn"
    label: str = "ticker_source"
    seed: tuple[str, ...] = tuple(CRYPTO_SEED)
    n: int = 20
    quote: str = "USDT"
    anchors: tuple[str, ...] = ("BTC/USDT", "ETH/USDT")
    exchange: str = "binance"

    def __post_init__(self):
        if self.n <= 0:
            raise ValueError(f"top_n must be > 0, got {self.n}")
        self.anchors = tuple(dict.fromkeys(self.anchors))

    def _seeded(self, day: dt.date, reason: str) -> DataFrame:
        return self._snapshot(day, self.seed[: self.n], source="seed", reason=reason, top_n=self.n)

    def _found(self, day: dt.date, found: object) -> DataFrame:
        """A source gives a mapping of symbol to volume or a DataFrame (symbol, quote_volume)."""
        tickers = found if isinstance(found, DataFrame) else self.spark.createDataFrame(
            [(s, None if v is None else float(v)) for s, v in dict(found).items()], "symbol string, quote_volume double"
        )
        facts = {"builder": self.name, "source": f"{self.label}({self.exchange})", "quote_currency": self.quote, "top_n": str(self.n), "anchors": ",".join(self.anchors)}
        chosen = top_n(tickers, self.n, self.quote, self.anchors)
        return chosen.agg(F.array_sort(F.collect_set("symbol")).alias("members")).select(
            F.lit(day).alias("as_of"), "members", F.create_map(*[F.lit(x) for pair in facts.items() for x in pair]).alias("metadata")
        )
