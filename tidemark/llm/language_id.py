"""Language identification by segmentation-marginalised unigrams.

The pieces of a fixed public vocabulary get a probability in each language, by expectation maximisation over all
segmentations of the training words. A text's likelihood is the product over its words of the sum over all segmentations
of the word into pieces, by the forward algorithm; the posterior over the languages follows from it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import built, cut, drop, group_samples, mix64, powers, remainder, share, ship, slices

#: Bound of the training sample: texts by language, taken whole, and letters of a word that is used for training.
TEXTS, LETTERS = 400, 512
#: Rounds of EM and smoothing.
ROUNDS, SMOOTH = 3, 0.05
#: Probability of a character that no piece covers.
UNKNOWN = 1e-7
#: Lattice cells (words times characters) of one pass, and letters of a word from which it forms a pass of its own.
CELLS, LONG = 1 << 16, 512
#: Words whose likelihoods a worker keeps.
CACHE = 300_000
UNDETERMINED = "und"
OUT = "doc_id long, held_out boolean, lang_pred string, score double"

_WORD = re.compile(r"[^\W\d_]+")


def vocabulary(path: str) -> list[str]:
    """The pieces of a sentencepiece model that are text, with a blank for the word start mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    pieces = {p.replace("▁", " ").lower() for p in pieces}
    return sorted(p for p in pieces if p.strip() and " " not in p[1:])


class Pieces:
    """Looks up the pieces that end at each place of many words at once."""

    def __init__(self, pieces: list[str]):
        self.longest = max(map(len, pieces), default=1)
        codes = self._codes(pieces)
        lengths = np.array([len(p) for p in pieces], int)
        hashes = mix64(self._prefix(codes)[np.arange(len(pieces)), lengths])
        order = np.argsort(hashes)
        self.hashes, self.ids, self.n = hashes[order], order.astype(np.int32), len(pieces)
        bits = 20
        self.shift = np.uint64(64 - bits)
        self.start = np.searchsorted(self.hashes, np.arange((1 << bits) + 1, dtype=np.uint64) << self.shift) if len(pieces) else np.zeros((1 << bits) + 1, int)
        self.start[-1] = len(pieces)

    @staticmethod
    def _codes(words: list[str]) -> np.ndarray:
        width = max(map(len, words), default=1)
        return np.array(words, dtype=f"U{width}").view(np.uint32).reshape(len(words), width)

    @staticmethod
    def _prefix(codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
        np.cumsum(mix64(codes.astype(np.uint64)) * powers(codes.shape[1])[0][: codes.shape[1]], axis=1, out=out[:, 1:])
        return out

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece ids, n for none; a bucket holds few hashes, which are tried in turn."""
        bucket = (hashes >> self.shift).astype(np.int64)
        at, end = self.start[bucket], self.start[bucket + 1]
        out = np.full(len(hashes), self.n, np.int32)
        open_ = np.flatnonzero(at < end)
        while len(open_):
            hit = self.hashes[at[open_]] == hashes[open_]
            out[open_[hit]] = self.ids[at[open_[hit]]]
            open_ = open_[~hit]
            at[open_] += 1
            open_ = open_[at[open_] < end[open_]]
        return out

    def lattice(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces [word, end, length - 1], and word lengths."""
        codes = self._codes(words)
        lengths = np.array([len(w) for w in words])
        prefix = self._prefix(codes)
        n, width = codes.shape
        down = powers(width)[1]
        out = np.full((n, width + 1, self.longest), self.n, np.int32)
        for size in range(1, min(self.longest, width) + 1):
            row, first = np.nonzero(lengths[:, None] >= np.arange(size, width + 1)[None, :])
            out[row, first + size, size - 1] = self.find(mix64((prefix[row, first + size] - prefix[row, first]) * down[first]))
        return out, lengths


def passes(words: list[str]) -> Iterator[list[str]]:
    """The words in passes of about equal length and bounded lattices."""
    words, at = sorted(words, key=len), 0
    while at < len(words):
        # The longest of a pass is its last; half as many of twice the length fill as many cells.
        n = max(1, CELLS // (len(words[at]) + 1))
        n = max(1, min(n, CELLS // (len(words[min(at + n, len(words)) - 1]) + 1)))
        yield words[at : at + n]
        at += n


def forward(lattice: np.ndarray, probability: np.ndarray) -> np.ndarray:
    """Logs of the sums over all segmentations [word, end, language]; ``probability`` has a last row of zeros for no piece.

    Each end is computed relative to the one before, so that nothing underflows, however long a word is.
    """
    n, width, longest = lattice.shape
    out = np.zeros((n, width, probability.shape[1]))
    for end in range(1, width):
        before = out[:, end - 1]
        total = np.full(before.shape, UNKNOWN)
        for size in range(1, min(longest, end) + 1):
            ids = lattice[:, end, size - 1]
            live = np.flatnonzero(ids < len(probability) - 1)
            if len(live):
                step = probability[ids[live]]
                total[live] += step if size == 1 else np.exp(out[live, end - size] - before[live]) * step
        out[:, end] = before + np.log(total)
    return out


def forward_long(finder: Pieces, word: str, probability: np.ndarray) -> np.ndarray:
    """The same sum for one long word [language], character by character, with only as many sums held as a piece is long."""
    logs, longest, step = np.zeros(probability.shape[1]), finder.longest, 1 << 16
    window = np.zeros((longest, probability.shape[1]))  # the sum of ``size`` characters before stands at size - 1
    window[0] = 1
    done = 0
    while done < len(word):
        first = max(0, done - longest)
        ids = finder.lattice([word[first : done + step]])[0][0, done - first + 1 :]
        for row in ids:
            total = window[0] * UNKNOWN + (window * probability[row]).sum(0)
            window[1:] = window[:-1]
            window[0] = total
            if total.min() < 1e-100:
                window /= total
                logs += np.log(total)
        done += len(ids)
    return logs + np.log(window[0])


def expected(lattice: np.ndarray, lengths: np.ndarray, counts: np.ndarray, probability: np.ndarray) -> np.ndarray:
    """Expected piece counts of one language (forward-backward)."""
    alpha = forward(lattice, probability[:, None])[:, :, 0]
    n, width, longest = lattice.shape
    beta = np.full((n, width), -np.inf)
    beta[np.arange(n), lengths] = 0
    whole = alpha[np.arange(n), lengths]
    out = np.zeros(len(probability))
    for start in range(width - 2, -1, -1):
        rows = np.flatnonzero(lengths > start)
        after = beta[rows, start + 1]
        total = np.full(len(rows), UNKNOWN)
        for size in range(1, min(longest, width - 1 - start) + 1):
            ids = lattice[rows, start + size, size - 1]
            live = np.flatnonzero(ids < len(probability) - 1)
            if len(live):
                at, arc = rows[live], probability[ids[live]]
                total[live] += arc * np.exp(beta[at, start + size] - after[live])
                out += np.bincount(ids[live], counts[at] * arc * np.exp(alpha[at, start] + beta[at, start + size] - whole[at]), len(probability))
        beta[rows, start] = after + np.log(total)
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        langs, words, counts = [], [], []
        for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
            langs.append(lang)  # a language without words is learned, too
            words.append("")
            counts.append(0)
            for word, n in Counter(_WORD.findall((text or "").lower())).items():
                langs.append(lang)
                words.append(word)
                counts.append(n)
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(counts, pa.int64())], ["lang", "word", "n"])


def _maximised(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Expected counts of the pieces, by language, summed over a task's words (lang, word, n)."""
    langs, finder, probability = built(shared, lambda model: (model[0], Pieces(model[1]), model[2]), _trained)
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        of, words, counts = (batch.column(c).to_pylist() for c in ("lang", "word", "n"))
        for lang in set(of):
            held = {" " + w: n for x, w, n in zip(of, words, counts, strict=True) if x == lang}
            p = probability[:, langs.index(lang)]
            for part in passes(list(held)):
                lattice, lengths = finder.lattice(part)
                sums[lang] = sums.get(lang, 0) + expected(lattice, lengths, np.array([held[w] for w in part], float), p)
    for lang, total in sums.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at])], ["lang", "piece", "n"])


def train(docs: DataFrame, pieces: list[str], folds: int = 4, out_fold: int = 2) -> tuple[list[str], list[str], np.ndarray]:
    """Languages, pieces and log-free probabilities [piece + 1, language] from the bounded sample of training documents.

    The sample holds TEXTS whole texts of each language; words of more than LETTERS letters don't train. A round of
    expectation maximisation is one aggregation over the sample's words, whose result is as large as the vocabulary times the
    number of languages. A language without any text isn't learned.
    """
    ship(docs.sparkSession)
    allowed = docs.where(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder("doc_id", folds) != out_fold)
    ).select("doc_id", "lang", "text", F.xxhash64("text").alias("hash"))
    chosen = group_samples(allowed, "lang", TEXTS, "l", "doc_id", "hash").repartition("lang", "doc_id", "hash")
    counted = cut(chosen.mapInArrow(_counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")))
    langs = sorted(r["lang"] for r in counted.select("lang").distinct().collect())
    probability = np.zeros((len(pieces) + 1, len(langs)))
    probability[:-1] = 1 / max(1, len(pieces))
    words = counted.where((F.col("word") != "") & (F.length("word") <= LETTERS))
    for _ in range(ROUNDS if langs else 0):
        shared = share(docs.sparkSession, (langs, pieces, probability))

        def maximise(batches, shared=shared):
            return _maximised(batches, shared)

        found = np.zeros((len(pieces), len(langs)))
        sums = words.repartition("word").mapInArrow(maximise, "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
        for r in sums.collect():
            found[r["piece"], langs.index(r["lang"])] = round(r["n"], 6)  # sums of doubles differ in the last digits with their order
        found += SMOOTH
        probability[:-1] = found / found.sum(0)
        shared.unpersist()
    drop(counted)
    return langs, pieces, probability


class Scorer:
    """Log-likelihoods of words by language, kept for the words seen last."""

    def __init__(self, pieces: list[str], probability: np.ndarray):
        self.finder, self.probability = Pieces(pieces), probability
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, probability.shape[1]))

    def learn(self, words: list[str]) -> None:
        rows = [self.table]
        for block in passes(words):
            lattice, lengths = self.finder.lattice([" " + w for w in block])
            rows.append(forward(lattice, self.probability)[np.arange(len(block)), lengths])
            for w in block:
                self.known[w] = len(self.known)
        self.table = np.concatenate(rows)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        """Log-likelihoods [text, language]; words of one call are learned together."""
        counts = [Counter(_WORD.findall(t.lower())) if t else Counter() for t in texts]
        long = [{w: c.pop(w) for w in [w for w in c if len(w) > LONG]} for c in counts]
        fresh = set().union(*counts).difference(self.known)
        if len(fresh) + len(self.known) > CACHE:
            fresh, self.known, self.table = set().union(*counts), {}, self.table[:0]
        if fresh:
            self.learn(list(fresh))
        out = np.zeros((len(texts), self.table.shape[1]))
        for i, (c, more) in enumerate(zip(counts, long, strict=True)):
            if c:
                at = np.fromiter(map(self.known.__getitem__, c), np.int64, len(c))
                out[i] = np.fromiter(c.values(), np.float64, len(c)) @ self.table[at]
            for word, n in more.items():
                out[i] += n * forward_long(self.finder, " " + word, self.probability)
        return out


_trained: dict[str, tuple] = {}
_built: dict[str, tuple] = {}


def _predicted(batches: Iterator[pa.RecordBatch], shared, folds: int, out_fold: int) -> Iterator[pa.RecordBatch]:
    langs, scorer = built(shared, lambda model: (model[0], Scorer(*model[1:])), _built)
    names = np.array([*langs, UNDETERMINED], object)
    for part in slices(batches):
        texts = part.column("text").to_pylist()
        letters = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], bool)
        if langs:
            logs = scorer(texts)
            shares = np.exp(logs - logs.max(1, keepdims=True))
            shares /= shares.sum(1, keepdims=True)
            best = np.where(letters, shares.argmax(1), len(langs))
            score = np.where(letters, shares.max(1), 0.0)
        else:
            best, score = np.zeros(len(texts), int), np.zeros(len(texts))
        held = [None if i is None else zlib.crc32(str(i).encode()) % folds == out_fold for i in part.column("doc_id").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(held, pa.bool_()), pa.array(names[best].tolist(), pa.string()), pa.array(score)],
            ["doc_id", "held_out", "lang_pred", "score"],
        )


def identify(docs: DataFrame, model: tuple[list[str], list[str], np.ndarray], folds: int = 4, out_fold: int = 2) -> DataFrame:
    """Language and posterior for every whole text of (doc_id long, text); one row per input row, repeated rows included.

    A null text or one without a letter is ``und`` with score 0, as is every text of a model without languages; among equal
    likelihoods the first language by name wins; held_out is null for a null doc_id; other columns are ignored; an empty
    table gives no rows. The prediction sees the text alone.
    """
    ship(docs.sparkSession)
    shared = share(docs.sparkSession, model)  # vocabulary size times languages

    def run(batches):
        return _predicted(batches, shared, folds, out_fold)

    return docs.select("doc_id", "text").mapInArrow(run, OUT)
