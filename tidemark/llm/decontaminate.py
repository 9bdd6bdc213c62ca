"""Benchmark decontamination: one Aho-Corasick automaton over the normalised windows of all items scans each text once.

A text is normalised to its words (ASCII letters and digits, lower-cased, and every non-ASCII character) joined by single
spaces; a window of an item is ``window`` consecutive words, or the whole item if it has fewer. Matches end at word ends,
which are mapped back to words, and on request to code point offsets of the original.

Where the windows of a large benchmark don't fit in an automaton, most of them occur in no document. A Bloom filter of their
hashes and a join by hash first find those that do; only these go on to the automaton, which decides on the text itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_LOWER, built, cut, drop, free, gram_hashes, plain, share, ship, signed, slices, text_bytes, word_hashes

#: Bytes of window text in one automaton; bits of the filter for each window of a larger benchmark, and at most.
AUTOMATON_BYTES, BLOOM, BLOOM_BITS = 4 << 20, 16, 1 << 28
OUT = (
    "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
    "items array<string>, spans array<struct<first:long, end:long>>"
)
#: What the passes over a text add up.
STATE = (("n_words", "bigint"), ("runs", "array<bigint>"), ("items", "array<string>"))
_SPACED = bytes(int(b) or 32 for b in ALNUM_LOWER)

_built: dict[str, object] = {}


def normalised(text: bytes) -> list[bytes]:
    return text.translate(_SPACED).split()


def item_windows(words: list[bytes], window: int) -> set[bytes]:
    if not words:
        return set()
    return {b" ".join(words[i : i + window]) for i in range(max(1, len(words) - window + 1))}


def build(windows: dict[bytes, list[str]]):
    """The automaton; each window carries its number of words and its items."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for text, items in windows.items():
        automaton.add_word(f" {text.decode('latin-1')} ", (text.count(b" ") + 1, tuple(items)))
    automaton.make_automaton()
    return automaton


def scan(automaton, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
    """Which words lie in an occurrence of a window, and the items whose windows occur."""
    hit = np.zeros(len(words) + 1, np.int64)
    items: set[str] = set()
    if not words or not len(automaton):
        return hit[:-1] > 0, items
    ends = None
    for last, (n, of) in automaton.iter(f" {b' '.join(words).decode('latin-1')} "):
        if ends is None:
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        k = int(np.searchsorted(ends, last))  # the space after word k stands at ends[k]
        hit[k + 1 - n] += 1
        hit[k + 1] -= 1
        items.update(of)
    return np.cumsum(hit)[:-1] > 0, items


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _spans(text: bytes, runs: tuple[np.ndarray, np.ndarray]) -> list[dict]:
    """Runs of words as code point offsets of the original text."""
    data = np.frombuffer(text, np.uint8)
    _, starts, ends, _ = word_hashes(data, np.array([0, len(data)]), ALNUM_LOWER)
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return [{"first": int(points[starts[a]]), "end": int(points[ends[b - 1]])} for a, b in zip(*runs, strict=True)]


def _scanned(batches: Iterator[pa.RecordBatch], shared, text: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Adds this automaton's hits to those of earlier passes: runs of hit words, and items; the last columns."""
    automaton = built(shared, build, _built)
    for batch in batches:
        carried, (_, runs_before, items_before) = batch.columns[: -len(STATE)], batch.columns[-len(STATE) :]
        data, bounds = text_bytes(carried[text])
        raw = data.tobytes()
        n_words, runs, found = [], [], []
        for row in range(batch.num_rows):
            words = normalised(raw[bounds[row] : bounds[row + 1]])
            hit, items = scan(automaton, words)
            old_runs, old_items = runs_before[row].as_py(), items_before[row].as_py()
            if old_runs:
                for a, b in zip(old_runs[::2], old_runs[1::2], strict=True):
                    hit[a:b] = True
            n_words.append(len(words))
            runs.append(np.stack(_runs(hit), 1).ravel().tolist() if len(words) and hit.any() else None)
            found.append(sorted(items.union(old_items or ())) or None)
        yield pa.RecordBatch.from_arrays(
            [*carried, pa.array(n_words, pa.int64()), pa.array(runs, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.string()))], names
        )


def _hits(runs: list[list[int] | None]) -> np.ndarray:
    return np.array([sum(r[1::2]) - sum(r[::2]) if r else 0 for r in runs], np.int64)


def _judged(batches: Iterator[pa.RecordBatch], share: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        doc_id, texts, n_words, runs, items = batch.columns
        runs, items, n_words = runs.to_pylist(), items.to_pylist(), n_words.to_numpy()
        n_hit = _hits(runs)
        spans = [
            _spans(texts[i].as_py().encode(), (np.array(r[::2]), np.array(r[1::2]))) if r else [] for i, r in enumerate(runs)
        ]
        yield pa.RecordBatch.from_arrays(
            [
                doc_id, pa.array(n_words, pa.int64()), pa.array(n_hit),
                pa.array([len(x or ()) for x in items], pa.int64()),
                pa.array([hashlib.sha256(",".join(x or ()).encode()).hexdigest() for x in items]),
                pa.array((n_hit > 0) & (share * n_hit >= n_words)),
                pa.array([x or [] for x in items], pa.list_(pa.string())),
                pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))),
            ],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans"],
        )


def _hashes(texts: pa.Array, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """The hashes of all runs of so many words, by number."""
    words, _, _, rows = word_hashes(*text_bytes(texts), ALNUM_LOWER)
    for n in sizes:
        found, whole = gram_hashes(words, rows, n)
        yield n, found[whole]


def _windowed(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """The distinct windows of each item, as normalised text, with their number of words and hash."""
    for batch in batches:
        for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            held = sorted(item_windows(normalised((text or "").encode()), window))
            if held:
                sizes = [w.count(b" ") + 1 for w in held]
                hashes = np.zeros(len(held), np.uint64)
                for n in set(sizes):
                    at = np.flatnonzero(np.array(sizes) == n)
                    hashes[at] = next(_hashes(pa.array([held[k].decode() for k in at]), [n]))[1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(held)), pa.array([w.decode() for w in held]), pa.array(sizes, pa.int32()), pa.array(signed(hashes))],
                    ["item_id", "window", "n", "hash"],
                )


def _bloom(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Four places of a hash in the filter."""
    with np.errstate(over="ignore"):
        return np.stack([(hashes >> np.uint64(16 * k) ^ hashes * np.uint64(2 * k + 1)) % np.uint64(bits) for k in range(4)])


def _possible(batches: Iterator[pa.RecordBatch], shared, sizes: list[int]) -> Iterator[pa.RecordBatch]:
    """The distinct hashes of a document's word runs that the filter lets pass."""
    bits = shared.value[1]
    for part in slices(batches):
        for _, hashes in _hashes(part.column("text"), sizes):
            hashes = np.unique(hashes)
            at = _bloom(hashes, len(bits) * 8)
            passed = hashes[((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(0)]
            yield pa.RecordBatch.from_arrays([pa.array(signed(passed))], ["hash"])


def occurring(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """A written table of those of the windows (item_id, window, n, hash) whose hash occurs in a document, and few others.

    The filter holds BLOOM bits a window, but never more than BLOOM_BITS; it only spares the join rows.
    """
    spark = docs.sparkSession
    sizes = sorted(r["n"] for r in windows.select("n").distinct().collect())
    size = int(min(BLOOM_BITS, max(1 << 10, BLOOM * windows.count()))) // 8 * 8
    bits = np.zeros(size // 8, np.uint8)
    for batch in windows.select("hash").distinct().toArrow().to_batches(1 << 16) if size < BLOOM_BITS else ():
        at = _bloom(batch.column("hash").to_numpy().view(np.uint64), size).ravel()
        np.bitwise_or.at(bits, at >> np.uint64(3), (1 << (at & np.uint64(7))).astype(np.uint8))
    if size >= BLOOM_BITS:
        bits[:] = 255
    shared = share(spark, bits)

    def possible(batches):
        return _possible(batches, shared, sizes)

    met = docs.select("text").where("text is not null").mapInArrow(possible, "hash long").distinct()
    return cut(windows.join(met, "hash", "left_semi"))


def scanned(docs: DataFrame, benchmark: DataFrame, window: int, automaton_bytes: int, finish, out) -> DataFrame:
    """What ``finish`` makes (schema ``out``) of the rows of ``docs`` with the hits of all automata in columns behind them (STATE).

    The automata live in executors, so their size is bounded: the benchmark is measured first; of one that is too large, only
    the windows that occur in documents are kept. If even these need several automata, each one is a pass over a written table.
    """
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text")

    def expand(batches):
        return _windowed(batches, window)

    windows = items.mapInArrow(expand, "item_id string, window string, n int, hash long")
    if (items.agg(F.sum(F.octet_length("text").cast("long") * window)).first()[0] or 0) > automaton_bytes:
        every = cut(windows)
        windows = occurring(docs, every)
        drop(every)
    else:
        windows = cut(windows)
    needed = windows.select("window").distinct().agg(F.sum(F.octet_length("window") + 2)).first()[0] or 0
    # Windows are dealt by hash, so each automaton gets about its share; a quarter is left for uneven ones.
    shards = max(1, -(-needed // (automaton_bytes * 3 // 4))) if needed > automaton_bytes else 1
    names = free(docs.columns, *(f"__{name}" for name, _ in STATE))
    state = docs.select("*", *[F.lit(None if kind[0] == "a" else 0).cast(kind).alias(name) for name, (_, kind) in zip(names, STATE, strict=True)])
    schema, text = state.schema, docs.columns.index("text")
    for shard in range(shards):
        of: dict[bytes, list[str]] = {}
        mine = windows.where(F.pmod(F.xxhash64("window"), F.lit(shards)) == shard)
        for row in mine.groupBy("window").agg(F.sort_array(F.collect_set("item_id")).alias("items")).toLocalIterator():
            of[row["window"].encode()] = row["items"]
        shared = share(spark, of)  # about automaton_bytes

        def run(batches, shared=shared, last=shard == shards - 1):
            found = _scanned(batches, shared, text, schema.names)
            return finish(found) if last else found

        if shard:
            state = cut(state)
        state = plain(state).mapInArrow(run, out if shard == shards - 1 else schema)
    drop(windows)
    return state


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, automaton_bytes: int = AUTOMATON_BYTES
) -> DataFrame:
    """Benchmark hits of every whole text of (doc_id, text) against the items (item_id, text).

    Per input row: n_words, n_hit (words inside an occurrence of any item's window), items (sorted ids, as strings) and
    their digest, spans of hit words, and contaminated: n_hit > 0 and ``share`` * n_hit >= n_words. A null or empty text
    has no words and is clean; an item without words has no window and a null item_id counts as "null"; repeated rows
    come out as often as they went in; an empty benchmark hits nothing; other columns are ignored.
    """

    def judge(batches):
        return _judged(batches, share)

    return scanned(docs.select("doc_id", "text"), benchmark, window, automaton_bytes, judge, OUT)


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, automaton_bytes: int = AUTOMATON_BYTES
) -> DataFrame:
    """The rows of (doc_id, text, ...) that aren't contaminated, whole and with all their columns, whatever their names; nulls as in
    ``decontaminate``."""
    width = len(docs.columns)

    def clean(batches):
        for batch in batches:
            n_hit = _hits(batch.column(width + 1).to_pylist())
            contaminated = (n_hit > 0) & (share * n_hit >= batch.column(width).to_numpy())
            yield batch.select(range(width)).filter(pa.array(~contaminated))

    return scanned(docs, benchmark, window, automaton_bytes, clean, docs.schema)
