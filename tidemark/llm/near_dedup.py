"""MinHash near-dedup with SetSketch registers.

A register is the exponentially spaced, truncated minimum of an exponential hash over a document's shingles: floor(1 -
log_b(rate * minimum)) within a byte. Registers merge by maximum, and two documents agree in a register about as often as
their Jaccard similarity.

1. Sketch every text; equal shingle sets form a class, and one member stands for it from here on.
2. Band register values: classes that share all registers of a band fall into a bucket.
3. Stars: each class is compared with the leader, the least class, of each of its buckets. A pair is compared by a likelihood estimate of the similarity
   (from the counts of greater, lesser and equal registers and the set sizes), then on the full shingle sets. The verified links' components come close to the groups: a large group of
   copies is joined by a number of comparisons in proportion to it.
4. Buckets: where a bucket still holds classes of several components, all pairs of different components are estimated, each
   pair in the first band that it shares only, and the classes with a partner near enough are compared on their full sets. A
   bucket too large for a task is split by bands of more registers of the same sketch, or, if only few of its classes lie outside
   its largest component, those are compared with all, block by block.
5. The verified links' components give the groups. No step closes over pairs that aren't verified.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK_LOWER, cut, drop, gram_hashes, grouped, join_hot, mix64, ship, slices, text_bytes, word_hashes
from .components import components

#: Registers, their base and rate; and the probability with which a pair at the threshold may share no band.
REGISTERS, BASE, RATE, MISS = 512, 1.1, 20.0, 1e-5
#: The same for the bands that split a large bucket.
MISS_SPLIT = 1e-6
#: Standard deviations that an estimate may lie below the threshold before verification is skipped; a pair at the threshold
#: lies lower with probability 3e-6.
MARGIN = 4.5
#: Classes, and shingles, that one task holds of either side.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Blocks of classes outside a bucket's largest component from which a large bucket is split.
OUTSIDE = 8
#: Keys up to this number are broadcast to pick rows; more are joined by shuffle.
BROADCAST_KEYS = 1 << 20

SKETCH = "doc_id long, n long, node long, check long, registers binary"
PAIRED = "task long, side int, node long, component long, band int, split int"
_FACTORS = mix64(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


def band_rows(threshold: float, registers: int = REGISTERS, miss: float = MISS) -> int:
    """The most registers a band can have so that a pair at the threshold shares no band with probability ``miss`` at most."""
    fits = [r for r in range(1, registers + 1) if (1 - threshold**r) ** (registers // r) <= miss]
    return max(fits, default=1)


def shingle_sets(part: pa.RecordBatch, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row's whole text: its k-word shingles, or all its words if fewer."""
    words, _, _, rows = word_hashes(*text_bytes(part.column("text")), BLANK_LOWER)
    first = np.searchsorted(rows, np.arange(part.num_rows + 1))
    grams, _ = gram_hashes(words, rows, k)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            out.append(gram_hashes(words[a:b], rows[a:b], b - a)[0] ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that only equal sets share."""
    if not len(shingles):
        return 0, 0
    a, b = mix64(shingles).sum(dtype=np.uint64), mix64(shingles + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def registers_of(sets: list[np.ndarray]) -> np.ndarray:
    """SetSketch registers [row, REGISTERS] of non-empty sets."""
    every = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    least = np.empty((len(sets), REGISTERS), np.uint64)
    scratch = np.empty(len(every), np.uint64)
    for i in range(REGISTERS):
        np.multiply(every, _FACTORS[i], out=scratch)
        least[:, i] = np.minimum.reduceat(scratch, starts)
    exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / math.log(BASE)), 0, 255).astype(np.uint8)


def _sketched(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        sets = shingle_sets(part, k)
        keys = [set_key(s) for s in sets]
        full = [i for i, s in enumerate(sets) if len(s)]
        registers: list[bytes | None] = [None] * len(sets)
        if full:
            for i, r in zip(full, registers_of([sets[i] for i in full]), strict=True):
                registers[i] = r.tobytes()
        yield pa.RecordBatch.from_arrays(
            [
                part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([a for a, _ in keys], pa.int64()),
                pa.array([b for _, b in keys], pa.int64()), pa.array(registers, pa.binary()),
            ],
            ["doc_id", "n", "node", "check", "registers"],
        )


def _full_sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        sets = shingle_sets(part, k)
        yield pa.RecordBatch.from_arrays(
            [pa.array([set_key(s)[0] for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "shingles"]
        )


def estimate(n_a: np.ndarray, n_b: np.ndarray, more: np.ndarray, less: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """Maximum likelihood Jaccard similarity of pairs, from set sizes and counts of registers where a is above, below, equal."""
    u = n_a / (n_a + n_b)
    v = 1 - u
    most = np.minimum(u / v, v / u)
    grid = np.linspace(0, 1, 101)[None, :] * most[:, None]

    def passes(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)

    p, q = passes(u[:, None] - v[:, None] * grid), passes(v[:, None] - u[:, None] * grid)
    floor = 1e-12
    odds = more[:, None] * np.log(p + floor) + less[:, None] * np.log(q + floor) + equal[:, None] * np.log(np.maximum(1 - p - q, floor))
    return grid[np.arange(len(grid)), odds.argmax(1)]


class Task:
    """The classes of one task: left ones (side 0 and 2) are compared with right ones (side 1 and 2)."""

    def __init__(self, rows: pa.Table, share: tuple[int, int]):
        self.rows, self.share = rows, share
        self.nodes, self.n, self.component, side, band, split = (
            rows.column(c).to_numpy() for c in ("node", "n", "component", "side", "band", "split")
        )
        self.registers = text_bytes(rows.column("registers"))[0].reshape(-1, REGISTERS)
        self.left, self.right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        self.alone, self.band, self.split = bool((side == 2).any()), int(band[0]), int(split[0])

    def first_met(self, equal: np.ndarray) -> np.ndarray:
        """Which pairs, by their equal registers, meet in this bucket and not in an earlier one."""
        if self.band < 0:
            return np.ones(len(equal), bool)

        def shared(width: int) -> np.ndarray:
            bands = REGISTERS // width
            return equal[:, : bands * width].reshape(len(equal), bands, width).all(2)

        whole = band_rows(self.share[0] / self.share[1])
        held = shared(whole)
        out = held[:, self.band] & ~held[:, : self.band].any(1)
        if self.split >= 0:
            width = split_rows(self.share)
            part = shared(width)
            part[:, [j for j in range(part.shape[1]) if overlaps(self.band, whole, j, width)]] = False
            out &= part[:, self.split] & ~part[:, : self.split].any(1)
        return out

    def near(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each left class with the right ones of other components whose estimated similarity may reach the threshold."""
        part, whole = self.share
        t = part / whole
        bar = t - MARGIN * math.sqrt(t * (1 - t) / REGISTERS)
        for place, i in enumerate(self.left):
            others = self.right[place + 1 :] if self.alone else self.right
            low, high = np.minimum(self.n[others], self.n[i]), np.maximum(self.n[others], self.n[i])
            others = others[(whole * low >= part * high) & (self.component[others] != self.component[i])]
            if not len(others):
                continue
            equal = self.registers[others] == self.registers[i]
            count = equal.sum(1)
            fit = count >= bar * REGISTERS
            others, equal, count = others[fit], equal[fit], count[fit]
            fit = self.first_met(equal)
            others, count = others[fit], count[fit]
            if not len(others):
                continue
            more = (self.registers[i] > self.registers[others]).sum(1)
            fit = estimate(np.full(len(others), self.n[i]), self.n[others], more, REGISTERS - more - count, count) >= bar
            if fit.any():
                yield int(i), others[fit]

    def partners(self) -> np.ndarray:
        """The classes with at least one near enough."""
        found = np.zeros(len(self.nodes), bool)
        for i, others in self.near():
            found[i] = True
            found[others] = True
        return np.flatnonzero(found)

    def links(self) -> Iterator[tuple[int, int]]:
        """Links verified on the full sets that join different components so far."""
        part, whole = self.share
        data, bounds = text_bytes(self.rows.column("shingles"))
        sets = [data[a:b].copy().view(np.uint64) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        _, start = np.unique(self.component, return_inverse=True)
        parent = list(range(int(start.max()) + 1))

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for i, others in self.near():
            for j in others.tolist():
                a, b = root(start[i]), root(start[j])
                if a == b:
                    continue
                x, y = (sets[i], sets[j]) if len(sets[i]) <= len(sets[j]) else (sets[j], sets[i])
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                common = int((y[at] == x).sum())
                if whole * common >= part * (len(x) + len(y) - common):
                    parent[max(a, b)] = min(a, b)
                    yield int(self.nodes[i]), int(self.nodes[j])


def split_rows(share: tuple[int, int]) -> int:
    """Registers of the bands that split a bucket: those of the bucket's own band and its neighbours' overlaps don't count."""
    whole = band_rows(share[0] / share[1])
    return band_rows(share[0] / share[1], REGISTERS - 3 * whole, MISS_SPLIT)


def overlaps(band: int, whole: int, split: int, width: int) -> bool:
    """Whether two bands of different widths share a register."""
    return split * width < (band + 1) * whole and band * whole < (split + 1) * width


def _pruned(batches: Iterator[pa.RecordBatch], share: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    for rows in grouped(batches, "task"):
        if len(rows) > 1:
            kept = rows.take(pa.array(Task(rows, share).partners())).drop_columns(["n", "registers"])
            yield from kept.to_batches()


def _verified(batches: Iterator[pa.RecordBatch], share: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    for rows in grouped(batches, "task"):
        found = list(Task(rows, share).links()) if len(rows) > 1 else []
        if found:
            a, b = np.array(found).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def pick(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among ``keys`` (a written table): by broadcast if their number is small, else by shuffle."""
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, key, "left_semi")


def _by_task(rows: DataFrame, run, schema: str) -> DataFrame:
    """Without a number of partitions, Spark joins small ones, so that few rows don't become many files."""
    return rows.repartition("task").sortWithinPartitions("task", "side", "node").mapInArrow(run, schema)


def compared(tasks: DataFrame, docs: DataFrame, classes: DataFrame, k: int, share: tuple[int, int]) -> DataFrame:
    """A written table of the verified links (a, b) of tasks (PAIRED): registers prune the classes first, so that only those
    with a partner near enough bring their full sets."""

    def prune(batches):
        return _pruned(batches, share)

    def verify(batches):
        return _verified(batches, share)

    def sets(batches):
        return _full_sets(batches, k)

    order = ["task", "side", "node", "component", "band", "split"]
    with_registers = lambda rows: rows.join(classes.select("node", "n", "registers"), "node").select(*order, "n", "registers")
    left = cut(_by_task(with_registers(tasks), prune, PAIRED))
    wanted = cut(left.select("node").distinct().join(classes.select("node", "doc_id"), "node").select("doc_id").distinct())
    full = cut(pick(docs.select("doc_id", "text"), wanted, "doc_id").mapInArrow(sets, "node long, shingles binary").dropDuplicates(["node"]))
    ready = with_registers(left).join(full, "node").select(*order, "n", "registers", "shingles")
    links = cut(_by_task(ready, verify, "a long, b long"))
    drop(left, wanted, full)
    return links


def _blocks(count: str, held: str) -> Column:
    return F.greatest(F.ceil(F.col(count) / BLOCK), F.ceil(F.col(held) / BLOCK_SHINGLES), F.lit(1)).cast("long")


def _place(count: str, salt: int = 0) -> Column:
    return F.pmod(F.xxhash64("node", F.lit(salt)), F.col(count))


def star_tasks(stars: DataFrame) -> DataFrame:
    """Tasks of the pairs (node, n, leader): blocks of a leader's classes, each with the leader beside it."""
    sizes = cut(stars.groupBy("leader").agg(F.count(F.lit(1)).alias("count"), F.sum("n").alias("held")))
    sizes = sizes.select("leader", "count", _blocks("count", "held").alias("blocks"))
    alone = [F.lit(-1).alias("band"), F.lit(-1).alias("split")]
    members = join_hot(stars.select("node", "leader"), sizes, "leader", "count", stars.count())
    sides = members.select(F.xxhash64("leader", _place("blocks")).alias("task"), F.lit(1).alias("side"), "node", F.col("node").alias("component"), *alone)
    heads = sizes.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    task = F.xxhash64("leader", "block").alias("task")
    return sides.unionByName(heads.select(task, F.lit(0).alias("side"), F.col("leader").alias("node"), F.col("leader").alias("component"), *alone))


def bucket_tasks(rows: DataFrame, classes: DataFrame, share: tuple[int, int], splits: bool = True) -> DataFrame:
    """A written table of the tasks of the buckets (key, band, split, node, n, component) that hold several components."""
    rows = cut(rows)
    parts = rows.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    stats = parts.groupBy("key").agg(
        F.sum("c").alias("count"), F.sum("s").alias("held"), F.count(F.lit(1)).alias("components"), F.max(F.struct("c", "component", "s")).alias("most"),
    ).where("components > 1")
    stats = stats.withColumn("outside", F.col("count") - F.col("most.c")).withColumn("outside_held", F.col("held") - F.col("most.s"))
    stats = stats.withColumn("blocks", _blocks("count", "held")).withColumn("outer", _blocks("outside", "outside_held"))
    stats = cut(stats.select("key", "count", F.col("most.component").alias("main"), "blocks", "outer"))
    met = join_hot(rows, stats, "key", "count", rows.count())
    columns = ["task", "side", "node", "component", "band", "split"]
    large, to_split = F.col("blocks") > 1, (F.col("blocks") > 1) & (F.col("outer") > OUTSIDE) & F.lit(splits)
    out = met.where(~large).select(F.col("key").alias("task"), F.lit(2).alias("side"), *columns[2:])
    if not stats.where(large).isEmpty():
        blocks = met.where(large & ~to_split)
        # Task (key, i, j) holds block i of those outside the main component as side 0 and block j of all as side 1.
        every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))
        outside = blocks.where("component <> main").withColumn("j", every("blocks")).withColumn("i", _place("outer", 1))
        inside = blocks.withColumn("i", every("outer")).withColumn("j", _place("blocks", 2))
        task = F.xxhash64("key", "i", "j").alias("task")
        for side, dealt in enumerate((outside, inside)):
            out = out.unionByName(dealt.select(task, F.lit(side).alias("side"), *columns[2:]))
    tables = [rows, stats]
    if splits and not stats.where(to_split).isEmpty():
        whole, width = band_rows(share[0] / share[1]), split_rows(share)
        finer = met.where(to_split).select("key", "band", "node", "n", "component").join(classes.select("node", "registers"), "node")
        finer = finer.select("key", "band", "node", "n", "component", F.posexplode(_banded(width)).alias("split", "part"))
        meets = (F.col("split") * width < (F.col("band") + 1) * whole) & (F.col("band") * whole < (F.col("split") + 1) * width)
        finer = finer.where(~meets).select(F.xxhash64("key", "part").alias("key"), "band", "split", "node", "n", "component")
        tables.append(bucket_tasks(finer, classes, share, splits=False))
        out = out.unionByName(tables[-1])
    out = cut(out)
    drop(*tables)
    return out


def _banded(rows: int) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(REGISTERS // rows - 1)), lambda i: F.xxhash64(i, F.substring("registers", i * rows + 1, F.lit(rows)))
    )


def class_groups(docs: DataFrame, classes: DataFrame, k: int, share: tuple[int, int]) -> DataFrame:
    """A written table (node, component) of the classes (node, doc_id of its member, n, registers) that are linked."""
    rows = band_rows(share[0] / share[1])
    banded = classes.select("node", "n", F.posexplode(_banded(rows)).alias("band", "key"))
    buckets = cut(banded.groupBy("key").agg(F.count(F.lit(1)).alias("count"), F.min("node").alias("leader")).where("count > 1"))
    shared = cut(join_hot(banded, buckets, "key", "count", classes.count() * (REGISTERS // rows)).drop("count"))
    drop(buckets)
    stars = cut(shared.where("node <> leader").select("node", "n", "leader").distinct())
    tasks = cut(star_tasks(stars))
    first = compared(tasks, docs, classes, k, share)
    drop(stars, tasks)
    groups = components(first)
    placed = shared.join(groups, "node", "left").select("key", "band", F.lit(-1).alias("split"), "node", "n", F.coalesce("component", "node").alias("component"))
    several = placed.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count(F.lit(1)).alias("count")).where("a <> b")
    several = cut(several.select("key", "count"))
    if several.isEmpty():
        drop(shared, first, several)
        return groups
    tasks = bucket_tasks(join_hot(placed, several, "key", "count", shared.count()).drop("count"), classes, share)
    second = compared(tasks, docs, classes, k, share)
    drop(shared, several, tasks)
    if not second.isEmpty():
        groups = components(first.unionByName(second))
    drop(first, second)
    return groups


def near_duplicates(docs: DataFrame, k: int = 5, share: tuple[int, int] = (4, 5)) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of (doc_id long, text).

    Documents are linked if share[1] * |intersection| >= share[0] * |union| of their k-word shingle sets (A-Z lower-cased;
    words between white space; fewer words: the whole sequence). component_id is the least doc_id reachable over links.
    A text that is null or has no words, and a row without doc_id, is linked with nothing and kept; rows that share doc_id
    and set are linked and both come back; other columns are ignored; an empty table gives no rows. A pair at the threshold
    is missed with probability MISS (and MISS_SPLIT in a bucket that is split), and ever less above it.
    """
    ship(docs.sparkSession)

    def sketch(batches):
        return _sketched(batches, k)

    sketches = cut(docs.select("doc_id", "text").mapInArrow(sketch, SKETCH))
    linked = sketches.where("n > 0 and doc_id is not null")
    classes = cut(
        linked.groupBy("n", "node", "check").agg(F.min("doc_id").alias("doc_id"), F.any_value("registers").alias("registers")).drop("check")
    )
    groups = class_groups(docs, classes, k, share)
    owned = classes.select("node", "doc_id").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = owned.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_class = owned.join(least, "component").select("node", "component_id")
    found = linked.select("doc_id", "n", "node").join(of_class, "node").select("doc_id", "n", "component_id")
    rest = sketches.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return found.unionByName(rest).select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )
