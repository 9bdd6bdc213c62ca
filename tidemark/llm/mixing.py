"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight schedule over training time 0..1. Its integral is the source's weight, from which its target
follows; scaled to the target, it is the source's cumulative demand of words, and inverting it turns the place of each copy
of a document in its source's stream into a training position. Copies are then range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns, free

#: A source's target stops at so many times its size.
MOST_REPEATS = 3
#: The production curriculum: (time, weight) knots of the sources in order, repeating; linear between the knots. The first
#: kind of source is wanted early, the second all along, the third late. Their integrals are as 1 to 2 to 3, which is fixed.
CURRICULUM = (
    ((0.0, 2.0), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 2.25), (1.0, 2.25)),
    ((0.0, 1.5), (0.5, 3.0), (1.0, 6.0)),
)
#: Hex digits of the order hash that make up a source's buckets: 16**3 buckets hold its running sums.
BUCKET_DIGITS = 3
WORD = "[^\\x20\\x09-\\x0D]+"
OWN = ("size", "source_size", "target", "taken", "copies")
COPY = ("epoch", "words", "position", "place")


def integral(knots: tuple[tuple[float, float], ...]) -> list[float]:
    """The integral of a schedule from 0 to each of its knots."""
    times, weights = [t for t, _ in knots], [w for _, w in knots]
    if times[0] != 0 or times[-1] != 1 or any(a >= b for a, b in zip(times, times[1:], strict=False)) or min(weights) < 0 or not max(weights):
        raise ValueError(f"a schedule has rising times from 0 to 1 and weights of at least 0, not all 0: {knots}")
    areas = [0.0]
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        areas.append(areas[-1] + (w0 + w1) / 2 * (t1 - t0))
    return areas


def source_weights(curriculum) -> list[float]:
    """The weights of the sources in order, repeating: the integrals of their schedules, relative to the first."""
    areas = [integral(knots)[-1] for knots in curriculum]
    return [area / areas[0] for area in areas]


def inverse_demand(share: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """The time by which a source with this schedule has delivered ``share`` of its words.

    In the piece where the integral reaches the share, it solves weight * d + slope * d**2 / 2 = rest for the time d since
    the piece began, in the form that holds without a slope, too. Weights are taken relative to the largest, since the
    scale of a schedule doesn't matter here.
    """
    areas, top = integral(knots), max(w for _, w in knots)
    areas, knots = [a / top for a in areas], [(t, w / top) for t, w in knots]
    area, out = share * F.lit(areas[-1]), None
    for (t0, w0), (t1, w1), done, end in reversed(list(zip(knots, knots[1:], areas, areas[1:], strict=False))):
        rest, slope = F.greatest(area - F.lit(done), F.lit(0.0)), (w1 - w0) / (t1 - t0)
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * rest, F.lit(0.0)))
        time = F.lit(t0) + F.coalesce(F.try_divide(2 * rest, F.lit(w0) + root), F.lit(0.0))
        out = time if out is None else F.when(area < F.lit(end), time).otherwise(out)
    return F.least(F.lit(1.0), out)


def source_targets(sizes: DataFrame, curriculum=CURRICULUM) -> DataFrame:
    """Targets by source from (source, source_size): the integrals of the schedules share all words; a source stops at
    MOST_REPEATS times its size and its excess goes to the others by weight, until none is above.

    That is the level at which least(cap, level * weight) sums to all words: sources are capped in the order of
    cap / weight. One small row per source; rank counts the sources from 0 in order.
    """
    order, by_ratio = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sizes.withColumn("rank", F.row_number().over(order) - 1)
    weights = source_weights(curriculum)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights)).cast("int") + 1)
    capped = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * MOST_REPEATS)
    ratio = capped.withColumn("ratio", F.col("cap") / F.col("weight"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    levels = ratio.withColumn("level", level)
    # From the first source whose ratio the level doesn't pass, levels only fall.
    final = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything)
    return levels.select(
        "source",
        "source_size",
        "rank",
        F.when(F.col("ratio") < final, F.col("cap").cast("double")).otherwise(final * F.col("weight")).alias("target"),
    )


def mix_sources(docs: DataFrame, seed: str = "mix", curriculum=CURRICULUM) -> DataFrame:
    """The mix of (doc_id, source, text): every input row with all its columns, its size, its source's size and target, the
    words taken, and copies array<struct<epoch, words, position, place>>: the words and the training position of each copy,
    and its place, which is the number of words before it in its source's stream.

    A source's stream holds its documents in the order of a hash of their ids and texts, over and over, until the rounded
    target is delivered; only its very last copy may be cut, so each source delivers its target to the word and no document
    more than MOST_REPEATS times its size. A copy's position is the time at which the source's cumulative demand reaches the
    copy's place in the stream. A null text or one without words has size 0 and takes nothing; a null source is a source of
    its own, the last in order; a null id is an empty one; repeated rows are documents of their own. Where the input has a
    column named as one of these, the new one gets an underscore behind its name. An empty table gives no rows.

    The running sums go over (source, bucket of the hash), so a hot source is spread over all tasks; only sums by bucket
    meet by source.
    """
    z, h, s, b, before, size, target, rank, at, whole, rest, source = free(docs.columns, *(f"__{c}" for c in ("z", "h", "s", "b", "before", "size", "target", "rank", "at", "whole", "rest", "source")))
    text_hash = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    hashed = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text_hash).cast("binary"))
    rows = docs.select(
        "*",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias(z),
        hashed.alias(h),
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")).alias(s),
    ).withColumn(b, F.substring(h, 1, BUCKET_DIGITS))
    sums = rows.groupBy(s, b).agg(F.first("source").alias(source), F.sum(z).alias("held"))
    totals = sums.groupBy(s).agg(F.first(source).alias("source"), F.sum("held").alias("source_size"))
    targets = source_targets(totals.drop(s), curriculum).select(
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")).alias(s),
        F.col("source_size").alias(size),
        F.col("target").alias(target),
        F.col("rank").alias(rank),
    )
    earlier = Window.partitionBy(s).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    buckets = sums.select(s, b, F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias(before)).join(targets, s)
    within = Window.partitionBy(s, b).orderBy(h, z).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(buckets, [s, b]).withColumn(at, F.col(before) + F.coalesce(F.sum(z).over(within), F.lit(0)))
    demand = F.round(target).cast("long")

    def copy(epoch: Column) -> Column:
        place = epoch * F.col(size) + F.col(at)
        share = F.least(F.lit(1.0), place / F.greatest(demand, F.lit(1)))
        position = inverse_demand(share, curriculum[-1])
        for k, knots in enumerate(curriculum[:-1]):
            position = F.when(F.col(rank) % len(curriculum) == k, inverse_demand(share, knots)).otherwise(position)
        words = F.greatest(F.lit(0), F.least(F.col(z), demand - place)).cast("long")
        return F.struct(epoch.alias("epoch"), words.alias("words"), position.alias("position"), place.alias("place"))

    rounds = F.when(F.col(size) > 0, F.expr(f"cast(round({target}) as bigint) div {size}")).otherwise(F.lit(0)).cast("long")
    copies = F.filter(F.transform(F.sequence(F.lit(0).cast("long"), rounds), lambda epoch: copy(epoch)), lambda c: c["words"] > 0)
    names = free(docs.columns, *OWN)
    taken = F.aggregate(names[-1], F.lit(0).cast("long"), lambda acc, c: acc + c["words"])
    return placed.withColumn(names[-1], copies).select(
        *columns(docs.columns), *(F.col(c).alias(name) for c, name in zip((z, size, target), names, strict=False)), taken.alias(names[3]), names[4]
    )


def training_order(mix: DataFrame, partitions: int) -> DataFrame:
    """One row per copy in the mix of ``mix_sources``, with the copy's epoch, words, position and place instead of the copies,
    range-sorted by position; documents of which nothing is taken come last, once, with no words and nulls for the rest.

    Ties go by source, doc_id and epoch. Where the mix has a column named as one of these, the new one gets an underscore
    behind its name.
    """
    every = mix.columns
    held, (epoch, words, position, at) = every[-1], free(every[:-1], *COPY)
    copy, key = free(every, "__copy", "__key")
    placed = mix.select(*columns(every[:-1]), F.explode_outer(held).alias(copy)).select(
        *columns(every[:-1]),
        F.col(copy)["epoch"].alias(epoch),
        F.coalesce(F.col(copy)["words"], F.lit(0).cast("long")).alias(words),
        F.col(copy)["position"].alias(position),
        F.col(copy)["place"].alias(at),
        F.coalesce(F.col(copy)["position"], F.lit(2.0)).alias(key),
    )
    order = [key, "source", "doc_id", epoch]
    return placed.repartitionByRange(partitions, *order).sortWithinPartitions(*order).drop(key)


def mixed_documents(ordered: DataFrame) -> DataFrame:
    """The documents of a training order of (doc_id, source), one row each, read back from their copies: the words taken, the
    number of copies, and the positions of the first and the last.

    The place of a document's first copy, unlike its id, is its own in its source's stream; each round puts the next copy
    source_size words further.
    """
    own = ["doc_id", "size", "source_size", "target"]
    taken = ordered.where("epoch is not null").withColumn("first_place", F.expr("place - epoch * source_size"))
    read = taken.groupBy(*own, "source", "first_place").agg(
        F.sum("words").alias("taken"),
        F.count(F.lit(1)).alias("n_copies"),
        F.min("position").alias("first_position"),
        F.max("position").alias("last_position"),
    )
    none = F.lit(None).cast("double")
    left = ordered.where("epoch is null").select(
        *own, F.col("words").alias("taken"), F.lit(0).cast("long").alias("n_copies"), none.alias("first_position"), none.alias("last_position")
    )
    return read.select(*left.columns).unionByName(left)
