"""Connected components by randomised contraction in DataFrames, until the edges that are left fit in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop

#: Rows of a task in the rounds: few edges aren't spread over all the partitions that a large shuffle needs.
ROWS_A_TASK = 250_000
#: Edges that one task joins at once.
LAST = 250_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every node of at most LAST edges with one node of its component."""
    ends = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches]
    if not ends:
        return
    nodes, at = np.unique(np.concatenate(ends, axis=1), return_inverse=True)
    a, b = at.reshape(2, -1)
    labels = np.arange(len(nodes))
    while True:
        # Ends take the lesser label of the two; labels of labels follow.
        least = np.minimum(labels[a], labels[b])
        lower = labels.copy()
        for side in (a, b, labels[a], labels[b]):
            np.minimum.at(lower, side, least)
        lower = lower[lower]
        if (lower == labels).all():
            break
        labels = lower
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[labels])], ["node", "to"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a long, b long); component is the least node that it reaches.

    In each round a node moves to the neighbour with the least salted hash, if that is less than its own, and the edges are
    drawn anew between where their ends moved; a constant share of the nodes goes each round, also on long paths. Only
    least values by node are shuffled, summed up before the shuffle, so that a hub's edges never meet in one task. Once LAST edges
    or fewer are left, one task joins them. Null ends and loops don't count; repeated edges count once; no edges give no rows.
    Rounds are cut by written tables.
    """
    live = cut(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    left_over = live.count()
    parts = max(1, -(-left_over // ROWS_A_TASK))
    width = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def kept(df: DataFrame) -> DataFrame:
        return cut(df.coalesce(parts) if parts < width else df)

    moves: list[DataFrame] = []
    while left_over > LAST:
        salt = F.lit(len(moves))
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min_by("b", F.xxhash64("b", salt)).alias("b"))
        move = kept(
            near.select(
                F.col("a").alias("node"),
                F.when(F.xxhash64("b", salt) < F.xxhash64("a", salt), F.col("b")).otherwise(F.col("a")).alias("to"),
            )
        )
        moves.append(move)
        ends = live.join(move.toDF("a", "p"), "a").join(move.toDF("b", "q"), "b")
        left = kept(ends.where("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct())
        drop(live)
        live, left_over = left, left.count()
    if left_over:
        moves.append(cut(live.coalesce(1).mapInArrow(_joined, "node long, to long")))
    if not moves:
        drop(live)
        return edges.sparkSession.createDataFrame([], "node long, component long")
    at = moves[0].select("node", F.col("to").alias("root"))
    for move in moves[1:]:
        at = at.join(move.toDF("root", "next"), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    at = kept(at)
    drop(live, *moves)
    least = at.groupBy("root").agg(F.min("node").alias("component"))
    out = kept(at.join(least, "root").select("node", "component"))
    drop(at)
    return out
