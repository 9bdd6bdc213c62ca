"""Embedding near-dedup by NN-descent.

1. Equal vectors of a label form a class that one vector stands for; their number is kept.
2. A first neighbour graph comes from random hyperplane codes: classes whose codes agree are compared in blocks.
3. Each round joins the neighbours of a class, both ways, with one another (neighbours of neighbours), if one of the two edges
   is new, and keeps the best of each list. A list whose entries all reach the threshold is saturated and grows.
4. Threshold edges draw clusters. Inside a cluster all pairs are compared in double precision, in blocks of bounded size, so
   that link counts are exact there however long the lists would be; only sums leave a task. Clusters of more classes than a
   list holds may fill one another's lists with nearer entries, so those whose centres and radii allow a link between them
   are compared with one another in the same way.
5. An audit compares vectors with all others of their label, by label and number of links found. Where too few linked vectors
   have all their links, descent goes on with longer lists; labels that still fall short, or are small, are compared whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, drop, grouped, ship
from .components import components

#: Length of a neighbour list, of a saturated one as a multiple, most rounds, and the share of new edges that ends descent.
NEIGHBOURS, GROWN, ROUNDS, STILL = 8, 4, 5, 0.005
#: Hyperplane codes, their bits, and classes in a block.
CODES, BITS, BLOCK = 4, 24, 128
#: Classes in one side of a verification task.
CLUSTER_BLOCK = 1024
#: Linked vectors that the audit expects to meet by label and group size, the share of them that needs all its links, and how
#: often descent may go on.
AUDIT, RECALL, TRIES = 1024, 0.995, 3
#: Classes of the largest label for which a whole comparison costs less than further descent.
WHOLE = 16 * CLUSTER_BLOCK
#: Single precision is trusted this far below the threshold while candidates are drawn.
SLACK = 1e-4


def _units(column: pa.Array) -> list[np.ndarray | None]:
    """Vectors of length 1 in double precision; None for null, zero, empty, and null or non-finite components."""
    out: list[np.ndarray | None] = []
    for value in column:
        held = value.values if value.is_valid else None
        if held is None or not len(held) or held.null_count:
            out.append(None)
            continue
        x = np.asarray(held.to_numpy(zero_copy_only=False), np.float64)
        if not np.isfinite(x).all() or not (largest := np.abs(x).max()):
            out.append(None)
            continue
        x = x / largest  # keeps squares in range
        out.append(x / np.sqrt(x @ x))
    return out


def _normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        units = _units(batch.column("embedding"))
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), batch.column("label"), pa.array([None if u is None else (u + 0.0).tobytes() for u in units], pa.binary())],
            ["vec_id", "label", "unit"],
        )


def _coded(batches: Iterator[pa.RecordBatch], codes: int) -> Iterator[pa.RecordBatch]:
    """Each class once per code, with the code's leading ``bits`` as its block."""
    for batch in batches:
        units = [np.frombuffer(u.as_buffer(), np.float64) for u in batch.column("unit")]
        bits = batch.column("bits").to_numpy()
        places = np.zeros((codes, len(units)), np.int64)
        for dim in {len(u) for u in units}:
            rows = [i for i, u in enumerate(units) if len(u) == dim]
            matrix = np.stack([units[i] for i in rows])
            for code in range(codes):
                planes = np.random.default_rng([code, dim]).standard_normal((dim, BITS))
                signs = (matrix @ planes > 0) @ (1 << np.arange(BITS, dtype=np.int64))
                places[code, rows] = signs & ((1 << bits[rows]) - 1)
        small = [u.astype(np.float32).tobytes() for u in units]
        for code in range(codes):
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("space"), pa.array(np.full(len(units), code)), pa.array(places[code]), batch.column("node"),
                    pa.array(small, pa.binary()),
                ],
                ["space", "code", "place", "node", "vector"],
            )


def _best(sims: np.ndarray, most: int) -> np.ndarray:
    """Which entries of each row are among its ``most`` largest."""
    if sims.shape[1] <= most:
        return np.ones(sims.shape, bool)
    return sims >= np.partition(sims, -most, axis=1)[:, -most, None]


def _local(batches: Iterator[pa.RecordBatch], most: int, bar: float) -> Iterator[pa.RecordBatch]:
    """Proposals (node, near, sim) among the members of each task: pairs with a new edge that beat the member's worst entry,
    the best ``most`` of each member and GROWN times as many that reach the bar."""
    nodes_out, near_out, sims_out = [], [], []
    size = 0

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(nodes_out)), pa.array(np.concatenate(near_out)), pa.array(np.concatenate(sims_out))], ["node", "near", "sim"]
        )
        nodes_out.clear()
        near_out.clear()
        sims_out.clear()
        return out

    for group in grouped(batches, "task"):
        nodes, first = np.unique(group.column("node").to_numpy(), return_index=True)
        if len(nodes) < 2:
            continue
        fresh = np.zeros(len(nodes), bool)
        np.logical_or.at(fresh, np.searchsorted(nodes, group.column("node").to_numpy()), group.column("fresh").to_numpy(zero_copy_only=False))
        if not fresh.any():
            continue
        taken = group.take(pa.array(first))
        vectors = np.stack([np.frombuffer(v.as_buffer(), np.float32) for chunk in taken.column("vector").chunks for v in chunk])
        worst = taken.column("worst").to_numpy()
        sims = vectors @ vectors.T
        good = (sims > worst[:, None]) & (fresh[:, None] | fresh[None, :])
        np.fill_diagonal(good, False)
        sims = np.where(good, sims, -2.0)
        good &= _best(sims, most) | ((sims >= bar) & _best(sims, GROWN * most))
        i, j = np.nonzero(good)
        if len(i):
            nodes_out.append(nodes[i])
            near_out.append(nodes[j])
            sims_out.append(sims[i, j].astype(np.float64))
            size += len(i)
            if size >= 50_000:
                size = 0
                yield flush()
    if nodes_out:
        yield flush()


def _run_tasks(rows: DataFrame, most: int, bar: float) -> DataFrame:
    def run(batches):
        return _local(batches, most, bar)

    ready = rows.select("task", "node", "fresh", "worst", "vector")
    return ready.repartition("task").sortWithinPartitions("task", "node").mapInArrow(run, "node long, near long, sim double")


def code_blocks(classes: DataFrame) -> DataFrame:
    """A written table of the classes once per hyperplane code, with the code's leading bits as their place."""
    sizes = classes.groupBy("space").agg(F.count(F.lit(1)).alias("held"))
    bits = F.least(F.lit(BITS), F.greatest(F.lit(0), F.ceil(F.log2(F.col("held") / (BLOCK / 2))))).cast("long")

    def run(batches):
        return _coded(batches, CODES)

    return cut(
        classes.join(sizes.select("space", bits.alias("bits")), "space")
        .select("space", "bits", "node", "unit")
        .mapInArrow(run, "space long, code long, place long, node long, vector binary")
    )


def first_proposals(coded: DataFrame, k: int, bar: float) -> DataFrame:
    """Proposals from blocks of classes that share a place."""
    counts = coded.groupBy("space", "code", "place").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("blocks"))
    task = F.xxhash64("space", "code", "place", F.pmod(F.xxhash64("node"), F.col("blocks")))
    rows = coded.join(counts, ["space", "code", "place"]).select(
        task.alias("task"), "node", F.lit(True).alias("fresh"), F.lit(-1.5).alias("worst"), "vector"
    )
    return _run_tasks(rows, k, bar)


def next_proposals(graph: DataFrame, vectors: DataFrame, k: int, bar: float) -> DataFrame:
    """Joins the neighbours of each class with one another. Long reverse lists are dealt over several tasks, each with the
    whole forward list. A list whose entries all reach the bar takes whatever reaches it until it has grown."""
    live = graph.where("fresh").select(F.explode(F.array("node", "near")).alias("centre")).distinct()
    forward = graph.select(F.col("node").alias("centre"), F.col("near").alias("node"), "fresh")
    backward = graph.select(F.col("near").alias("centre"), "node", "fresh")
    shares = backward.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("parts"))
    shares = live.join(shares, "centre", "left").select("centre", F.coalesce("parts", F.lit(1)).alias("parts"))
    dealt = backward.join(shares, "centre").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    copied = forward.join(shares, "centre").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    rows = dealt.unionByName(copied).select(F.xxhash64("centre", "part").alias("task"), "node", "fresh")
    held, least = F.count(F.lit(1)), F.min("sim")
    entry = F.when(held < k, F.lit(-1.5)).when((held < GROWN * k) & (least >= bar), F.lit(bar)).otherwise(least)
    worst = graph.groupBy("node").agg(entry.alias("worst"))
    return _run_tasks(rows.join(vectors.join(worst, "node", "left").withColumn("worst", F.coalesce("worst", F.lit(-1.5))), "node"), k, bar)


def merge(graph: DataFrame | None, proposals: DataFrame, k: int, bar: float) -> DataFrame:
    """The best k of each list; of entries that reach the bar, GROWN times as many."""
    found = proposals.select("node", "near", "sim", F.lit(True).alias("fresh"))
    if graph is not None:
        found = found.unionByName(graph.withColumn("fresh", F.lit(False)))
    each = found.groupBy("node", "near").agg(F.max("sim").alias("sim"), F.min("fresh").alias("fresh"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("sim"), "near"))
    ranked = each.withColumn("rank", rank)
    return ranked.where((F.col("rank") <= k) | ((F.col("sim") >= bar) & (F.col("rank") <= GROWN * k))).drop("rank")


def descend(graph: DataFrame | None, classes: DataFrame, vectors: DataFrame, k: int, threshold: float, rounds: int) -> DataFrame:
    """The neighbour graph (node, near, sim, fresh) after at most ``rounds`` rounds."""
    bar = threshold - SLACK
    if graph is None:
        coded = code_blocks(classes)
        graph = cut(merge(None, first_proposals(coded, k, bar), k, bar))
        drop(coded)
    total = max(1, graph.count())
    for _ in range(rounds):
        before, graph = graph, cut(merge(graph, next_proposals(graph, vectors, k, bar), k, bar))
        drop(before)
        if graph.where("fresh").count() <= STILL * total:
            break
    return graph


def _labels(linked: np.ndarray) -> np.ndarray:
    """Least row reachable from each row of a symmetric boolean matrix."""
    labels = np.arange(len(linked))
    while True:
        least = np.where(linked, labels[None, :], len(labels)).min(1)
        lower = np.minimum(labels, least)
        lower = lower[lower]
        if (lower == labels).all():
            return labels
        labels = lower


def _compared(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Per task: link counts (near null) and enough edges for the components (links 0)."""
    for group in grouped(batches, "task"):
        side, nodes = group.column("side").to_numpy(), group.column("node").to_numpy()
        copies = group.column("copies").to_numpy()
        units = np.stack([np.frombuffer(v.as_buffer(), np.float64) for chunk in group.column("unit").chunks for v in chunk])
        alone = bool((side == 2).any())
        a, b = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        linked = units[a] @ units[b].T >= threshold
        if alone:
            np.fill_diagonal(linked, False)
        counts = {}
        for rows, sums in ((a, linked @ copies[b]), *(() if alone else ((b, linked.T @ copies[a]),))):
            counts |= {int(nodes[r]): int(n) for r, n in zip(rows, sums, strict=True) if n}
        if alone:
            full, order = linked, a
        else:
            order, n = np.concatenate((a, b)), len(a)
            full = np.zeros((len(order), len(order)), bool)
            full[:n, n:], full[n:, :n] = linked, linked.T
        roots = _labels(full)
        moved = np.flatnonzero(roots != np.arange(len(roots)))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([*counts, *nodes[order[moved]].tolist()], pa.int64()),
                pa.array([None] * len(counts) + nodes[order[roots[moved]]].tolist(), pa.int64()),
                pa.array([*counts.values(), *[0] * len(moved)], pa.int64()),
            ],
            ["node", "near", "links"],
        )


def _reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The angle of each member with its cluster's centre."""
    for batch in batches:
        angles = [
            np.arccos(np.clip(np.frombuffer(u.as_buffer(), np.float64) @ np.frombuffer(c.as_buffer(), np.float64), -1, 1))
            for u, c in zip(batch.column("unit"), batch.column("centre"), strict=True)
        ]
        yield pa.RecordBatch.from_arrays([batch.column("cluster"), pa.array(angles, pa.float64())], ["cluster", "angle"])


def _allowed(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Pairs of clusters whose centres and radii allow a link between members."""
    for group in grouped(batches, "task"):
        side, clusters, radius = (group.column(c).to_numpy() for c in ("side", "cluster", "radius"))
        centres = np.stack([np.frombuffer(v.as_buffer(), np.float64) for chunk in group.column("centre").chunks for v in chunk])
        a, b = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        reach = np.minimum(radius[a][:, None] + radius[b][None, :] + np.arccos(threshold) + SLACK, np.pi)
        near = centres[a] @ centres[b].T >= np.cos(reach) - 1e-12
        if (side == 2).any():
            near = np.triu(near, 1)
        i, j = np.nonzero(near)
        yield pa.RecordBatch.from_arrays([pa.array(clusters[a[i]]), pa.array(clusters[b[j]])], ["one", "two"])


def _squared(dealt: DataFrame, key: str) -> DataFrame:
    """Rows of a key (with their block and number of blocks) for the tasks that compare all of its blocks with one another.

    Task (i, j), i < j, holds block i as side 0 and block j as side 1; task (i, i) holds block i as both, side 2."""
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    task = F.xxhash64(key, F.least("block", "other"), F.greatest("block", "other"))
    side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1)
    return dealt.withColumn("other", other).withColumn("task", task).withColumn("side", side)


def _by_task(rows: DataFrame, order: str, run, schema: str) -> DataFrame:
    return rows.repartition("task").sortWithinPartitions("task", "side", order).mapInArrow(run, schema)


def near_clusters(members: DataFrame, threshold: float, k: int) -> DataFrame:
    """Pairs (one, two) of clusters of more than k classes that may hold links with one another, by the triangle inequality of
    angles: the centre is a member, the radius the largest angle with it."""

    def run(batches):
        return _allowed(batches, threshold)

    full = members.groupBy("cluster", "space").agg(F.count(F.lit(1)).alias("n"), F.min_by("unit", "node").alias("centre")).where(F.col("n") > k)
    full = cut(full.select("cluster", "space", "centre"))
    reached = members.select("cluster", "unit").join(full.select("cluster", "centre"), "cluster").mapInArrow(_reached, "cluster long, angle double")
    balls = full.join(reached.groupBy("cluster").agg(F.max("angle").alias("radius")), "cluster")
    sizes = full.groupBy("space").agg(F.ceil(F.count(F.lit(1)) / CLUSTER_BLOCK).cast("long").alias("blocks"))
    dealt = balls.join(sizes, "space").withColumn("block", F.pmod(F.xxhash64("cluster"), F.col("blocks")))
    rows = _squared(dealt, "space").select("task", "side", "cluster", "radius", "centre")
    return cut(_by_task(rows, "cluster", run, "one long, two long"))


def cluster_links(graph: DataFrame, classes: DataFrame, threshold: float, k: int) -> DataFrame:
    """Rows (node, near, links): exact link counts inside the clusters of threshold edges and between those of more than k
    classes, and edges for the components."""
    clusters = components(graph.where(F.col("sim") >= threshold - SLACK).select(F.col("node").alias("a"), F.col("near").alias("b")))
    members = classes.join(clusters.withColumnRenamed("component", "cluster"), "node").select("cluster", "space", "node", "unit", "copies")
    sizes = members.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / CLUSTER_BLOCK).cast("long").alias("blocks"))
    dealt = members.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    columns = ["task", "side", "node", "copies", "unit"]
    rows = _squared(dealt, "cluster").select(columns)
    pairs = near_clusters(members, threshold, k)
    if not pairs.isEmpty():
        pairs = pairs.join(sizes.toDF("one", "ones"), "one").join(sizes.toDF("two", "twos"), "two")
        # Task (one, two, i, j) holds block i of cluster one as side 0 and block j of cluster two as side 1.
        for side, cluster, count in ((0, "one", "twos"), (1, "two", "ones")):
            other = F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))
            met = dealt.join(pairs.withColumn("cluster", F.col(cluster)), "cluster").withColumn("other", other)
            places = ("block", "other") if side == 0 else ("other", "block")
            rows = rows.unionByName(met.withColumn("task", F.xxhash64("one", "two", *places)).withColumn("side", F.lit(side)).select(columns))

    def run(batches):
        return _compared(batches, threshold)

    return cut(_by_task(rows, "node", run, "node long, near long, links long"))


def whole_links(classes: DataFrame, threshold: float) -> DataFrame:
    """Rows (node, near, links) as of ``cluster_links``, by comparing all classes of each label in blocks."""
    sizes = classes.groupBy("space").agg(F.ceil(F.count(F.lit(1)) / CLUSTER_BLOCK).cast("long").alias("blocks"))
    dealt = classes.join(sizes, "space").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))

    def run(batches):
        return _compared(batches, threshold)

    rows = _squared(dealt, "space").select("task", "side", "node", "copies", "unit")
    return cut(_by_task(rows, "node", run, "node long, near long, links long"))


def _asked(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Per task: true links of the audited classes (side 0) with the classes of a block (side 1)."""
    for group in grouped(batches, "task"):
        side, nodes = group.column("side").to_numpy(), group.column("node").to_numpy()
        units = np.stack([np.frombuffer(v.as_buffer(), np.float64) for chunk in group.column("unit").chunks for v in chunk])
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        linked = (units[a] @ units[b].T >= threshold) & (nodes[a][:, None] != nodes[b][None, :])
        sums = linked @ group.column("copies").to_numpy()[b]
        yield pa.RecordBatch.from_arrays([pa.array(nodes[a][sums > 0]), pa.array(sums[sums > 0])], ["node", "links"])


def audit(classes: DataFrame, links: DataFrame, threshold: float) -> DataFrame:
    """Labels (space, held) of which too few linked classes have all their links.

    A label's share is estimated from classes drawn by the number of links found for them, in powers of two, AUDIT of each.
    Of those without any, which may have lost them all, as many are drawn as hold AUDIT linked ones if these are as frequent
    as among the linked; all of a label in which no links were found. Each is compared with its whole label.
    """
    counted = links.where("near is null").groupBy("node").agg(F.sum("links").alias("found"))
    state = classes.join(counted, "node", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    state = cut(state.withColumn("group", F.floor(F.log2(F.col("found") + 1))).select("space", "node", "unit", "found", "group"))
    strata = state.groupBy("space", "group").agg(F.count(F.lit(1)).alias("size"))
    spaces = strata.groupBy("space").agg(F.sum("size").alias("held"), F.coalesce(F.sum(F.when(F.col("group") > 0, F.col("size"))), F.lit(0)).alias("known"))
    spaces = cut(spaces.withColumn("blocks", F.ceil(F.col("held") / CLUSTER_BLOCK).cast("long")))
    met = F.when(F.col("group") > 0, F.col("size")).otherwise(F.greatest("known", F.lit(1)))
    rates = strata.join(spaces, "space").select("space", "group", F.when(F.col("known") == 0, 1.0).otherwise(F.least(F.lit(1.0), AUDIT / met)).alias("rate"))
    place = F.pmod(F.xxhash64("node", F.lit("audit")), F.lit(1 << 30)) / (1 << 30)
    asked = cut(state.join(rates, ["space", "group"]).where(place < F.col("rate")).select("space", "node", "unit", "found", "rate"))
    parts = cut(asked.groupBy("space").agg(F.ceil(F.count(F.lit(1)) / CLUSTER_BLOCK).cast("long").alias("parts")).join(spaces.select("space", "blocks"), "space"))
    # Task (i, j) of a label holds part i of the audited classes and block j of all.
    mine, other = F.pmod(F.xxhash64("node"), F.col("parts")), F.pmod(F.xxhash64("node"), F.col("blocks"))
    questions = asked.join(parts, "space").select(
        "space", "node", "unit", F.lit(0).cast("long").alias("copies"), F.lit(0).alias("side"), mine.alias("i"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("j"),
    )
    answers = classes.join(parts, "space").select(
        "space", "node", "unit", "copies", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("i"),
        other.alias("j"),
    )
    rows = questions.unionByName(answers).select(F.xxhash64("space", "i", "j").alias("task"), "side", "node", "copies", "unit")

    def run(batches):
        return _asked(batches, threshold)

    true = _by_task(rows, "node", run, "node long, links long").groupBy("node").agg(F.sum("links").alias("n"))
    whole = F.when(F.col("found") >= F.col("n"), 1 / F.col("rate")).otherwise(0.0)
    shares = asked.join(true, "node").groupBy("space").agg((F.sum(whole) / F.sum(1 / F.col("rate"))).alias("share"))
    return cut(shares.where(F.col("share") < RECALL).join(spaces, "space").select("space", "held"))


def near_vectors(vectors: DataFrame, threshold: float = 0.98, k: int = NEIGHBOURS) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of (vec_id long, embedding array, label).

    Two rows with equal labels are linked if their cosine in double precision is at least the threshold; component_id is the
    least vec_id reachable over links. Rows whose vec_id or label is null, or whose vector is null, empty, zero or holds a
    null or non-finite component, are linked with nothing and kept, as are vectors of other lengths with one another.
    Repeated rows are vectors of their own; other columns are ignored; an empty table gives no rows.
    """
    ship(vectors.sparkSession)
    units = cut(
        vectors.select("vec_id", F.col("label").cast("string").alias("label"), "embedding").mapInArrow(
            _normalised, "vec_id long, label string, unit binary"
        )
    )
    space = F.xxhash64("label", F.length("unit"))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("unit").isNotNull()
    ready = units.where(usable).select("vec_id", space.alias("space"), F.xxhash64("label", "unit").alias("node"), "unit")
    classes = cut(ready.groupBy("space", "node", "unit").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least")))
    small = cut(classes.select("node", "unit").mapInArrow(_singles, "node long, vector binary"))
    graph, size, todo, done = None, k, classes, []
    for attempt in range(TRIES):
        graph = descend(graph, todo, small, size, threshold, ROUNDS)
        links = cluster_links(graph, todo, threshold, k)
        short = audit(todo, links, threshold)
        if short.isEmpty():
            done.append(links)
            break
        todo = cut(todo.join(short.select("space"), "space", "left_semi"))
        done.append(links.join(todo.select("node"), "node", "left_anti"))
        if attempt + 1 == TRIES or short.where(F.col("held") > WHOLE).isEmpty():
            done.append(whole_links(todo, threshold))
            break
        size *= 2
        before, graph = graph, cut(graph.join(todo.select("node"), "node", "left_semi").withColumn("fresh", F.lit(True)))
        drop(before)
    links = reduce(DataFrame.unionByName, done)
    groups = components(links.where("near is not null").select(F.col("node").alias("a"), F.col("near").alias("b")))
    counts = links.where("near is null").groupBy("node").agg(F.sum("links").alias("links"))
    owned = classes.join(groups, "node", "left").select("node", "copies", "least", F.coalesce("component", "node").alias("component"))
    least = owned.groupBy("component").agg(F.min("least").alias("component_id"))
    found = owned.join(least, "component").join(counts, "node", "left").select(
        "node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    linked = ready.select("vec_id", "node").join(found, "node").select("vec_id", "n_links", "component_id")
    rest = units.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).select(
        "vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept")
    )


def _singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = [np.frombuffer(u.as_buffer(), np.float64).astype(np.float32).tobytes() for u in batch.column("unit")]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(vectors, pa.binary())], ["node", "vector"])
