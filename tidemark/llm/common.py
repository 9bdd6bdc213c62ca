"""Helpers that several operators share: table access, shared checkpoints, Arrow text slices and numpy word hashing."""

from __future__ import annotations

import atexit
import os
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Text bytes that one numpy pass handles at once; a single longer text forms a pass of its own.
SLICE_BYTES = 1 << 20
#: Bytes of an Arrow batch.
BATCH_BYTES = 4 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Has Python workers give freed memory back at once and share one pool of it among their threads.
_FREED = {"MIMALLOC_PURGE_DELAY": "0", "MALLOC_ARENA_MAX": "1"}
#: Bytes of text hashed at once; longer runs are cut at a separator.
PIECE_BYTES = 1 << 20

_MIX_A = np.uint64(0xBF58476D1CE4E5B9)
_MIX_B = np.uint64(0x94D049BB133111EB)
_GOLDEN = 0x9E3779B97F4A7C15
_BASE = 0xD1342543DE82EF95
_MASK = (1 << 64) - 1


def ship(spark: SparkSession) -> None:
    """Lets Python workers find this package where it isn't installed but lies at the driver's path, keeps them from holding on
    to freed memory, and bounds the bytes of an Arrow batch, which Spark otherwise ends by rows alone, where neither the user nor
    the cluster has set them."""
    if not spark._jsparkSession.sessionState().conf().contains(_BATCH):
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    environment = spark.sparkContext.environment
    for name, value in _FREED.items():
        environment.setdefault(name, value)
    root = str(Path(__file__).resolve().parents[2])
    held = environment.get("PYTHONPATH", "")
    if root not in held.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, (root, held)))


def quoted(name: str) -> str:
    """A column's name as an expression, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def columns(names: list[str]) -> list[Column]:
    return [F.col(quoted(name)) for name in names]


def plain(df: DataFrame) -> DataFrame:
    """The same columns, where names hold dots or backticks under others, since ``mapInArrow`` can't address those."""
    odd = [c for c in df.columns if "." in c or "`" in c]
    return df.toDF(*(free(df.columns, f"__c{k}")[0] if c in odd else c for k, c in enumerate(df.columns))) if odd else df


def free(taken: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores behind it as set it apart from ``taken``, in any case of letters."""
    held, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the path may belong to any store that Spark reads."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """This session's folder below the one that the cluster names in ``spark.checkpoint.dir``.

    Only a session whose tasks run in its own process gets a folder below its warehouse without that setting; on a cluster
    the setting is needed.
    """
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        where = context.getConf().get("spark.checkpoint.dir")
        if not where and not context._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(where or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
        held = context._jsc.sc().getCheckpointDir()
    return held.get()


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage by a table in the shared folder, so that a lost executor costs no recomputation from the start.

    Unlike a checkpointed plan, a table read anew carries no constraints along, which would multiply over the rounds of an
    iteration, and its columns and filters are pruned and pushed down. The shuffle files of the write, which nothing reads
    again, go at its end. ``drop`` deletes the table; the rest goes with the session.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    if not _tables:
        atexit.register(_drop_all)
    _tables[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables of ``cut`` that nothing needs any more."""
    for df in tables:
        _delete(df._table)


_tables: dict[str, SparkSession] = {}


def _delete(path: str) -> None:
    spark = _tables.pop(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _drop_all() -> None:
    for path, spark in list(_tables.items()):
        if spark.sparkContext._jsc is not None and spark.sparkContext._jsc.sc().isStopped() is False:
            _delete(path)


def share(spark: SparkSession, value):
    """Broadcasts a value of bounded size under a name of its own, by which workers keep what they build from it."""
    return spark.sparkContext.broadcast((uuid.uuid4().hex, value))


def built(shared, make: Callable, kept: dict):
    """What ``make`` builds from a shared value, once per worker; ``kept`` holds the last one."""
    name, value = shared.value
    if name not in kept:
        kept.clear()
        kept[name] = make(value)
    return kept[name]


#: Rows from which a key may count as hot; beyond, one whose rows are more than 1 in 2**HOT_BITS of all.
HOT_ROWS, HOT_BITS = 10_000, 16


def join_hot(rows: DataFrame, keys: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """The inner join of ``total`` rows with a written table of one row a key, whose column ``n`` counts the key's rows.

    Hot keys, at most 2**HOT_BITS since each has more than that part of all rows, are broadcast, so that their rows stay
    where they are; the others meet by shuffle.
    """
    bar = max(HOT_ROWS, total >> HOT_BITS)
    hot = keys.where(F.col(n) > bar)
    if hot.isEmpty():
        return rows.join(keys, key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(keys.where(F.col(n) <= bar), key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of rows of one key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(key).to_numpy()
        if not len(keys):
            continue
        edges = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        starts, ends = [0, *edges.tolist()], [*edges.tolist(), len(keys)]
        for a, b in zip(starts, ends, strict=True):
            if held and held[0].column(key)[0].as_py() != keys[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and the row bounds (rows + 1) of an Arrow string column; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, bounds, data = column.buffers()
    if bounds is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(bounds, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return held, at - at[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches into runs of rows of about ``most`` text bytes, so memory follows bytes, not rows."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, bounds = text_bytes(batch.column(batch.schema.get_field_index(text)))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(bounds, bounds[first] + most, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def byte_table(separator: Callable[[int], bool], lower: bool) -> np.ndarray:
    """Maps each byte to itself (A-Z lower-cased on request) and separators to 0."""
    out = np.arange(256, dtype=np.uint8)
    if lower:
        out[65:91] += 32
    out[[b for b in range(256) if separator(b)]] = 0
    return out


def _blank(b: int) -> bool:
    return b == 0x20 or 0x09 <= b <= 0x0D


#: Byte 0 is a word byte by the contract of these words but marks separators here, so it is mapped to 0xFF, which UTF-8 never holds.
BLANK_LOWER = byte_table(_blank, True)
BLANK_LOWER[0] = 0xFF
BLANK_CASED = byte_table(_blank, False)
BLANK_CASED[0] = 0xFF
#: ASCII letters and digits and every byte of a non-ASCII character.
ALNUM_LOWER = byte_table(lambda b: b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F, True)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = (x ^ (x >> np.uint64(30))) * _MIX_A
    x = (x ^ (x >> np.uint64(27))) * _MIX_B
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _byte_values() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_GOLDEN))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0..n of an odd base and of its inverse modulo 2**64."""
    held = _powers.get(base)
    if held is None or len(held[0]) <= n:
        size = max(n + 1, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        held = (out[0], out[1])
        if size <= 4 * PIECE_BYTES:
            _powers[base] = held
    return held


def word_hashes(data: np.ndarray, bounds: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every word of a run of texts: 64-bit hash, first byte, end byte and row.

    ``letters`` maps bytes as in ``byte_table``. Words never cross a row.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    parts, a = [], 0
    while a < n:
        b = min(n, a + PIECE_BYTES)
        while b < n:
            gap = np.flatnonzero(letters[data[b : b + 4096]] == 0)
            edge = int(np.searchsorted(bounds, b))
            here = [b + int(gap[0])] if len(gap) else []
            if edge < len(bounds) and bounds[edge] <= b + 4096:
                here.append(int(bounds[edge]))
            if here:
                b = min(here)
                break
            b = min(n, b + 4096)
        parts.append(_piece(data[a:b], a, bounds, letters))
        a = b
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if len(parts) > 1 else parts[0]


def _piece(data: np.ndarray, offset: int, bounds: np.ndarray, letters: np.ndarray):
    n = len(data)
    mapped = letters[data]
    word = mapped != 0
    edges = bounds[np.searchsorted(bounds, offset, "right") : np.searchsorted(bounds, offset + n)] - offset
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = word[:-1]
    before[edges] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = word[1:]
    after[edges - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    up, down = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_byte_values()[mapped] * up[:n], out=total[1:])
    hashes = mix64((total[ends] - total[starts]) * down[starts])
    return hashes, starts + offset, ends + offset, _rows(starts + offset, bounds)


def _rows(starts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(bounds) - 1), np.diff(np.searchsorted(starts, bounds)))


def word_bounds(data: np.ndarray, bounds: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end byte and row of every word, without hashes."""
    word = letters[data] != 0
    n = len(word)
    edge = np.zeros(n + 1, bool)
    edge[1:n] = word[1:] != word[:-1]
    inner = bounds[1:-1]
    edge[inner] |= word[np.maximum(inner, 1) - 1] | word[np.minimum(inner, max(0, n - 1))] if n else False
    at = np.flatnonzero(edge[:n])
    at = np.concatenate(([0], at[at > 0])) if n else at
    keep = word[at] if n else np.zeros(0, bool)
    ends = np.append(at[1:], n)
    return at[keep], ends[keep], _rows(at[keep], bounds)


def gram_hashes(words: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words, and whether the run stays in one row; as long as there are runs."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    up, down = powers(len(words), _BASE ^ 0x5DEECE66C)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return mix64((total[k:] - total[:-k]) * down[:n]), rows[k - 1 :] == rows[:n]


def signed(x: np.ndarray) -> np.ndarray:
    """uint64 as the bit-equal int64 that Spark's long holds."""
    return x.view(np.int64)


def reach(found: np.ndarray, width: int, larger: bool) -> np.ndarray:
    """Sliding minimum (or maximum) over ``width`` neighbours to the right, by doubling; the last width-1 are dropped."""
    take = np.maximum if larger else np.minimum
    out, span = found, 1
    while span < width:
        step = min(span, width - span)
        out = take(out[:-step], out[step:])
        span += step
    return out


def hash_sample(rows: DataFrame, key: str, most: int, seed: str) -> DataFrame:
    """At most ``most`` rows, those whose key hashes least, alike in every run.

    A threshold taken from the count comes first, so that only about ``most`` rows are ever sorted, however many there are.
    """
    n = rows.count()
    order = F.xxhash64(F.lit(seed), F.col(key))
    if n > 2 * most:
        rows = rows.where(order < int(-(2**63) + 2**64 * min(1.0, 1.5 * most / n)))
    return rows.orderBy(order, key).limit(most)


def group_samples(rows: DataFrame, group: str, most: int, seed: str, *key: str) -> DataFrame:
    """At most ``most`` rows of each of a few groups, those whose key hashes highest, alike in every run.

    One pass counts the groups; a second takes the rows below each group's threshold, about 1.5 times as many as are kept,
    and only these are ranked.
    """
    counts = rows.groupBy(group).count().collect()
    bars = [(r[group], -(2**63) if r["count"] <= 2 * most else int(2**63 - 2**64 * min(1.0, 1.5 * most / r["count"]))) for r in counts]
    bars = rows.sparkSession.createDataFrame(bars, f"{group} {rows.schema[group].dataType.simpleString()}, __bar long")
    held = rows.withColumn("__order", F.xxhash64(F.lit(seed), *key)).join(F.broadcast(bars), group).where("__order >= __bar")
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("__order"), *key))
    return held.withColumn("__rank", rank).where(F.col("__rank") <= most).select(*rows.columns)


def remainder(key: str, of: int):
    """crc32 of the key as text, modulo ``of``."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % of
