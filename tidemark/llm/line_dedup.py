"""Line dedup by winnowing: later copies of any run of ``run`` words that occurs earlier in the corpus are deleted.

Shared passages start and end inside lines and often hold one line break or none, so the hashed lines are the word k-grams at
every offset rather than the text between line breaks, whose hashes would miss such passages. The steps:

1. Winnow. The k-gram of least hash in each window of ``run`` words is that window's anchor, so that equal windows have
   equal anchors: a shared run can't be missed. One row per anchor, about 2 in ``run - k + 2`` words, carries the k-gram's
   hash and a hash of the anchor's reach, the words of all windows that it is the anchor of.
2. Join positions. Counts by k-gram (summed before the shuffle) tell the anchors that occur more than once.
3. Extend. Where all occurrences of an anchor have the same reach, the match extends over all of it both ways. Elsewhere
   the windows around the anchor are compared one by one, which gives the exact ends of each match.
4. Delete. A window whose first occurrence (least doc_id, then position) is elsewhere is deleted, except for words that
   belong to that first occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import (
    BLANK_CASED,
    columns,
    cut,
    drop,
    free,
    gram_hashes,
    join_hot,
    mix64,
    plain,
    powers,
    reach,
    ship,
    signed,
    slices,
    text_bytes,
    word_bounds,
    word_hashes,
)

#: Least words of a deleted run, and words of the winnowed grams.
RUN, GRAM = 50, 20
#: An anchor's place in one long: 20 bits of the text's hash, 30 of the word's place, 6 each of the reach to both sides, and
#: whether its hash occurs again in the same run of rows (a window: text, place and that mark). A text of 2**31 bytes, Spark's
#: most, holds at most 2**30 words. The text's hash only tells texts of one doc_id apart.
TEXT_BITS, PLACE_BITS, REACH_BITS = 20, 30, 6
PLACE_AT = 2 * REACH_BITS + 1
TEXT_AT = PLACE_AT + PLACE_BITS


def _spread(words: np.ndarray, rows: np.ndarray, run: int, gram: int):
    """All windows of ``run`` words in one row: first word and anchor."""
    n = len(words) - run + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), None
    grams, _ = gram_hashes(words, rows, gram)
    # The place stands in the low bits, so that one minimum finds it; grams that agree above tie, and the first is taken.
    low = np.uint64((1 << max(1, len(grams).bit_length())) - 1)
    least = reach((grams & ~low) | np.arange(len(grams), dtype=np.uint64), run - gram + 1, False)
    firsts = np.flatnonzero(rows[run - 1 :] == rows[:n])
    return firsts, (least[firsts] & low).astype(np.int64), grams


def _prefix(words: np.ndarray) -> np.ndarray:
    up, _ = powers(len(words))
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return total


def _run_hash(total: np.ndarray, first: np.ndarray, end: np.ndarray, salt) -> np.ndarray:
    _, down = powers(len(total))
    return mix64((total[end] - total[first]) * down[first] + np.asarray(salt).astype(np.uint64))


def _row_first(rows: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(rows, np.arange(n))


def _again(hashes: np.ndarray) -> np.ndarray:
    """1 for hashes that occur more than once."""
    _, index, n = np.unique(hashes, return_inverse=True, return_counts=True)
    return (n[index] > 1).astype(np.int64)


def _anchors(batches: Iterator[pa.RecordBatch], run: int, gram: int) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        words, _, _, rows = word_hashes(*text_bytes(part.column("text")), BLANK_CASED)
        firsts, anchors, grams = _spread(words, rows, run, gram)
        if not len(firsts):
            continue
        edge = np.flatnonzero(anchors[1:] != anchors[:-1])
        s1, s2 = firsts[np.concatenate(([0], edge + 1))], firsts[np.concatenate((edge, [len(firsts) - 1]))]
        p = anchors[np.concatenate(([0], edge + 1))]
        row = rows[p]
        before, after = p - s1, p - s2
        extent = _run_hash(_prefix(words), s1, s2 + run, (before << REACH_BITS) | after)
        local = p - _row_first(rows, part.num_rows)[row]
        at = (part.column("part").to_numpy()[row] << TEXT_AT) | (local << PLACE_AT) | (before << REACH_BITS + 1) | (after << 1)
        at |= _again(grams[p])
        yield pa.RecordBatch.from_arrays(
            [pa.array(signed(grams[p])), pa.array(signed(extent)), part.column("doc_id").take(pa.array(row)), pa.array(at)],
            ["hash", "reach", "doc_id", "at"],
        )


def _windows(batches: Iterator[pa.RecordBatch], run: int) -> Iterator[pa.RecordBatch]:
    """The windows around the anchors whose reaches differ."""
    for part in slices(batches):
        words, _, _, rows = word_hashes(*text_bytes(part.column("text")), BLANK_CASED)
        first = _row_first(rows, part.num_rows)
        lists = part.column("mixed")
        sizes = np.diff(lists.offsets.to_numpy())
        at = lists.flatten().to_numpy()
        row = np.repeat(np.arange(part.num_rows), sizes)
        mask = (1 << REACH_BITS) - 1
        p = ((at >> PLACE_AT) & ((1 << PLACE_BITS) - 1)) + first[row]
        s1, s2 = p - ((at >> REACH_BITS + 1) & mask), p - ((at >> 1) & mask)
        n = s2 - s1 + 1
        s = np.repeat(s1, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        row = np.repeat(row, n)
        hashes = _run_hash(_prefix(words), s, s + run, 0)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(signed(hashes)), part.column("doc_id").take(pa.array(row)),
                pa.array((part.column("part").to_numpy()[row] << TEXT_AT) | ((s - first[row]) << PLACE_AT) | _again(hashes)),
            ],
            ["hash", "doc_id", "at"],
        )


def later_words(n: int, later: np.ndarray, own: np.ndarray, hashes: np.ndarray, run: int) -> np.ndarray:
    """Which of a text's n words are to go. A repeat: first word << REACH_BITS | windows - 1.

    All words of ``later`` go, which a lesser doc_id has, too. Of those in ``own``, which start in this text, the first of
    each hash and number of windows stays, as do its words in later ones that overlap it.
    """
    edge = np.zeros(n + 1, np.int64)
    first, windows = later >> REACH_BITS, (later & ((1 << REACH_BITS) - 1)) + 1
    start, end = first, first + windows - 1 + run
    if len(own):
        at, count = own >> REACH_BITS, (own & ((1 << REACH_BITS) - 1)) + 1
        order = np.lexsort((at, count, hashes))
        at, count, hashes = at[order], count[order], hashes[order]
        head = np.ones(len(at), bool)
        head[1:] = (hashes[1:] != hashes[:-1]) | (count[1:] != count[:-1])
        home = at[np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))]
        own_end = at + count - 1 + run
        start = np.concatenate((start, np.where(at == home, own_end, np.maximum(at, home + run))))
        end = np.concatenate((end, own_end))
    np.add.at(edge, np.minimum(start, n), 1)
    np.add.at(edge, np.minimum(end, n), -1)
    return np.cumsum(edge)[:-1] > 0


def cut_words(text: bytes, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> bytes:
    """The text without the words marked; a gap that is left closes to the white space that follows it."""
    edge = np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))
    kept, at = [], 0
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
        kept.append(text[at : starts[a]].rstrip(b" \t") if b == len(starts) or text[ends[b - 1] : ends[b - 1] + 1].isspace() else text[at : starts[a]])
        at = ends[b - 1]
    out = b"".join([*kept, text[at:]])
    return b"" if gone.all() else out


def _cleaned(batches: Iterator[pa.RecordBatch], run: int, names: list[str], more: list[str]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        data, bounds = text_bytes(part.column("text"))
        starts, ends, rows = word_bounds(data, bounds, BLANK_CASED)
        first = np.searchsorted(rows, np.arange(part.num_rows + 1))
        raw = data.tobytes()
        later, own = (part.column(c) for c in more[:2])
        spots, mine = later.flatten().to_numpy(), own.flatten()
        hashes, own_spots = mine.field("hash").to_numpy(), mine.field("spot").to_numpy()
        bounds_of = lambda x: np.concatenate(([0], np.cumsum(x.value_lengths().fill_null(0).to_numpy().astype(np.int64))))
        l_at, o_at = bounds_of(later), bounds_of(own)
        removed = np.zeros(part.num_rows, np.int64)
        texts: dict[int, str] = {}
        for row in np.flatnonzero((np.diff(l_at) > 0) | (np.diff(o_at) > 1)):
            a, b = first[row], first[row + 1]
            mine_at = slice(o_at[row], o_at[row + 1])
            gone = later_words(b - a, spots[l_at[row] : l_at[row + 1]], own_spots[mine_at], hashes[mine_at], run)
            if gone.any():
                removed[row] = gone.sum()
                base = bounds[row]
                texts[row] = cut_words(raw[base : bounds[row + 1]], starts[a:b] - base, ends[a:b] - base, gone).decode()
        columns = [part.column(k) for k in range(len(names))]
        if texts:
            at = names.index("text")
            changed = np.zeros(part.num_rows, bool)
            changed[list(texts)] = True
            columns[at] = pc.replace_with_mask(columns[at], pa.array(changed), pa.array(texts.values(), columns[at].type))
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(np.diff(first), pa.int64()), pa.array(removed)], [*names, *more[2:]]
        )


def _repeated(found: DataFrame, *more) -> DataFrame:
    """The hashes that occur more than once, how often, and the least doc_id that each occurs in."""
    return found.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"), *more).where("n > 1")


def _once(rows: DataFrame) -> DataFrame:
    """One of each group of rows (doc_id, text, part) that share doc_id and text."""
    keyed = rows.withColumn("full", F.xxhash64("text"))
    twice = cut(keyed.groupBy("doc_id", "full").count().where("count > 1").select("doc_id", "full"))
    if twice.isEmpty():
        return rows
    first = keyed.join(twice, ["doc_id", "full"], "left_semi").groupBy("doc_id", "full", "part").agg(F.first("text").alias("text"))
    names = ("doc_id", "text", "part")
    return keyed.join(twice, ["doc_id", "full"], "left_anti").select(*names).unionByName(first.select(*names))


def dedup_lines(docs: DataFrame, run: int = RUN, gram: int = GRAM) -> DataFrame:
    """All rows of (doc_id long, text, ...) with later runs cut from ``text``, plus n_words (before) and n_removed, last.

    A run is ``run`` or more consecutive words (between white space; line breaks count as white space) that also occur at
    an earlier place: a lesser doc_id, or earlier in the same text. Texts without such runs stay byte for byte. A text all
    of whose words go becomes empty. A null text stays null; rows without doc_id are returned as they are; rows that share
    a doc_id are one document, so that nothing is cut between them, and those that share the text, too, are cut alike; all
    columns stay, and where one is named as a new one, the new one gets an underscore behind its name. An empty table gives
    no rows.
    """
    assert gram < run and run - gram < 1 << REACH_BITS
    ship(docs.sparkSession)
    names = docs.columns
    n_words, n_removed, part, later_name, own_name = free(names, "n_words", "n_removed", "__part", "__later", "__own")
    keyed = docs.withColumn(part, F.xxhash64("text").bitwiseAND((1 << TEXT_BITS) - 1))
    known = keyed.where("doc_id is not null")
    texts = _once(known.where("text is not null").select("doc_id", "text", F.col(part).alias("part")))

    def find(batches):
        return _anchors(batches, run, gram)

    def expand(batches):
        return _windows(batches, run)

    def clean(batches):
        return _cleaned(batches, run, names, [later_name, own_name, n_words, n_removed])

    anchors = cut(texts.mapInArrow(find, "hash long, reach long, doc_id long, at long"))
    keys = cut(_repeated(anchors, (F.min("reach") != F.max("reach")).alias("mixed")))
    repeated = cut(join_hot(anchors.drop("reach"), keys, "hash", "n", anchors.count()).drop("n"))
    drop(anchors, keys)
    place = F.shiftright("at", TEXT_AT).alias("part")
    mask = (1 << REACH_BITS) - 1
    before, after = F.shiftright("at", REACH_BITS + 1).bitwiseAND(mask), F.shiftright("at", 1).bitwiseAND(mask)
    word = F.shiftright("at", PLACE_AT).bitwiseAND((1 << PLACE_BITS) - 1)
    # Where no lesser doc_id has a repeat, it matters only if its hash occurs again in this text.
    later, own = F.col("least") < F.col("doc_id"), F.col("at").bitwiseAND(1) == 1

    def spots(found: DataFrame, first, windows) -> DataFrame:
        spot = F.shiftleft(first, REACH_BITS).bitwiseOR(windows - 1)
        kept = found.where(later | own)
        return kept.select("doc_id", place, F.when(later, spot).alias("later"), F.when(~later, F.struct("hash", spot.alias("spot"))).alias("own"))

    whole = spots(repeated.where("not mixed"), word - before, before - after + 1)
    mixed = repeated.where("mixed").groupBy("doc_id", place).agg(F.collect_list("at").alias("mixed"))
    around = cut(texts.join(mixed, ["doc_id", "part"]).select("doc_id", "text", "part", "mixed").mapInArrow(expand, "hash long, doc_id long, at long"))
    again = cut(_repeated(around))
    single = spots(join_hot(around, again, "hash", "n", around.count()), word, F.lit(1).cast("long"))
    repeats = cut(whole.unionByName(single).groupBy("doc_id", "part").agg(F.collect_list("later").alias("later"), F.collect_list("own").alias("own")))
    drop(repeated, around, again)
    fields = [*docs.schema.fields, T.StructField(n_words, T.LongType()), T.StructField(n_removed, T.LongType())]
    marks = repeats.select("doc_id", *(F.col(a).alias(b) for a, b in (("part", part), ("later", later_name), ("own", own_name))))
    joined = known.join(marks, ["doc_id", part], "left").select(*columns(names), later_name, own_name)
    none = [F.lit(None).cast(kind).alias(c) for c, kind in ((later_name, "array<bigint>"), (own_name, "array<struct<hash:bigint,spot:bigint>>"))]
    bare = keyed.where("doc_id is null").select(*columns(names), *none)
    return plain(joined.union(bare)).mapInArrow(clean, T.StructType(fields))
