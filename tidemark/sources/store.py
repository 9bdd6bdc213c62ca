"""Bars at rest: Parquet partitioned by provider, symbol and frequency, and a table of provenance beside it."""

from __future__ import annotations

import datetime as dt
import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schema import BARS, SCHEMA_VERSION, Frequency
from ..functions.settings import Settings
from ..operators.quality import validate


#: Characters that are replaced in a symbol's path, and by what.
UNSAFE, SAFE = "/:\\", "-"


def _iso(time: str) -> Column:
    """An instant as text in UTC, whatever the session's zone is."""
    seconds = F.unix_seconds(F.col(time).cast("timestamp"))
    day, rest = F.date_from_unix_date(F.floor(seconds / 86_400).cast("int")), F.pmod(seconds, F.lit(86_400))
    clock = F.format_string("%02d:%02d:%02d", F.floor(rest / 3600), F.floor(F.pmod(rest, F.lit(3600)) / 60), F.pmod(rest, F.lit(60)))
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T"), clock, F.lit("+00:00"))


class BarStore:
    """Each (provider, symbol, frequency) is one partition, overwritten as a whole.

    A partition holds the path-safe symbol and, where that isn't the symbol itself, a hash of the symbol behind it, so that no
    two symbols share a partition; the raw symbol is a column.
    """

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, (root or Settings(spark).raw).rstrip("/")
        self.bars, self.meta = f"{self.root}/bars", f"{self.root}/meta"

    @staticmethod
    def safe(symbol: str) -> str:
        return symbol.translate(str.maketrans(UNSAFE, SAFE * len(UNSAFE)))

    @classmethod
    def folder(cls, symbol: str) -> str:
        plain = re.sub(r"[^A-Za-z0-9._-]", SAFE, symbol)
        return plain if plain == symbol else f"{plain}~{hashlib.sha256(symbol.encode()).hexdigest()[:12]}"

    @staticmethod
    def folder_column(symbol: Column) -> Column:
        plain = F.regexp_replace(symbol, "[^A-Za-z0-9._-]", SAFE)
        return F.when(plain == symbol, plain).otherwise(F.concat(plain, F.lit("~"), F.substring(F.sha2(symbol.cast("binary"), 256), 1, 12)))

    def path_for(self, provider: str, symbol: str, frequency: str) -> str:
        return f"{self.bars}/provider={provider}/safe_symbol={self.folder(symbol)}/freq={Frequency(frequency).folder}"

    def _there(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def exists(self, provider: str, symbol: str, frequency: str) -> bool:
        return self._there(self.path_for(provider, symbol, frequency))

    def write(self, bars: DataFrame, provider: str, symbol: str, frequency: str, extra: dict[str, str] | None = None, sequence: str | None = None) -> str:
        """Validates, then overwrites the partition and its provenance. Extra entries win over those made here."""
        named = bars.withColumns({"symbol": F.lit(symbol), "frequency": F.lit(str(Frequency(frequency)))})
        self.write_many(named, provider, sequence, extra)
        return self.path_for(provider, symbol, frequency)

    def write_many(self, bars: DataFrame, provider: str, sequence: str | None = None, extra: dict[str, str] | None = None) -> None:
        """Validates the bars of all (symbol, frequency), each in the order of ``sequence``, then overwrites their partitions, and
        their provenance, in one write each. The bars are computed once and held until both are done."""
        held = bars.persist()
        try:
            validate(held, keys=("symbol", "frequency"), sequence=sequence)
            freq = F.when(F.col("frequency") == str(Frequency.MONTHLY), Frequency.MONTHLY.folder).otherwise(F.col("frequency"))
            parts = {"provider": F.lit(provider), "safe_symbol": self.folder_column(F.col("symbol")), "freq": freq}
            rows = (held.drop(sequence) if sequence else held).withColumns(parts)
            facts = rows.groupBy(*parts, "symbol", "frequency").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
            entries = F.map_from_arrays(
                F.array(*map(F.lit, ("provider", "symbol", "frequency", "downloaded_at", "schema_version", "row_count", "start", "end"))),
                F.array(
                    F.lit(provider), "symbol", "frequency", F.lit(dt.datetime.now(dt.UTC).isoformat()), F.lit(SCHEMA_VERSION), F.col("n").cast("string"),
                    _iso("first"), _iso("last"),
                ),
            )
            if extra:
                more = F.create_map(*[F.lit(x) for pair in extra.items() for x in pair])
                entries = F.map_concat(F.map_filter(entries, lambda k, _: ~k.isin(*extra)), more)
            self._overwrite(rows.repartition(*parts).sortWithinPartitions(*parts, "timestamp"), list(parts), self.bars)
            self._overwrite(facts.select(*parts, entries.alias("entries")).coalesce(1), list(parts), self.meta)
        finally:
            held.unpersist()

    @staticmethod
    def _overwrite(rows: DataFrame, parts: list[str], path: str) -> None:
        writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "snappy")
        writer.partitionBy(*parts).parquet(path)

    def _meta_path(self, path: str) -> str:
        return self.meta + path[len(self.bars) :]

    def _partition(self, provider: str, symbol: str, frequency: str) -> str:
        path = self.path_for(provider, symbol, frequency)
        if not self._there(path):
            raise FileNotFoundError(f"no bars at {path}")
        return path

    def read(self, provider: str, symbol: str, frequency: str) -> DataFrame:
        found = self.spark.read.parquet(self._partition(provider, symbol, frequency))
        return found.where(F.col("symbol") == symbol).drop("symbol", "frequency")

    def read_all(self) -> DataFrame:
        """All partitions as one table; filters on provider, safe_symbol and freq prune, others are pushed down."""
        return self.spark.read.option("mergeSchema", "true").parquet(self.bars)

    def read_metadata(self, provider: str, symbol: str, frequency: str) -> dict[str, str]:
        path = self._meta_path(self._partition(provider, symbol, frequency))
        kept = F.map_filter("entries", lambda k, v: ~F.startswith(k, F.lit("pandas")))
        return dict(self.spark.read.parquet(path).select(kept.alias("entries")).first()["entries"])

    def metadata(self) -> DataFrame:
        """Provenance of all partitions."""
        return self.spark.read.parquet(self.meta)


def provenance(bars: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Rows, first and last time by key, in one aggregation."""
    return bars.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"), F.min("day").alias("start"), F.max("day").alias("end"))


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], BARS)
