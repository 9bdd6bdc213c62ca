"""Toxicity by non-negative positive-unlabelled learning: a numpy logistic model from confirmed toxic examples and unlabelled
text, trained on the risk estimate that the class prior corrects.

Features are words and word beginnings (blanks mark word ends) that occur at least once, twice, four or eight times. Those that set positives apart
from what the prior leaves of the unlabelled text are selected, and one Aho-Corasick automaton finds them in whole texts.
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

from .common import BLANK_LOWER, built, cut, gram_hashes, hash_sample, plain, remainder, share, ship, signed, slices, text_bytes, word_hashes

#: Bounds of the training sample: confirmed positives and unlabelled texts, both taken whole.
POSITIVES, UNLABELLED = 6_000, 12_000
#: Lengths of the word beginnings, blank included, and the counts from which each has a level; bound of the selected features, and what a feature needs: positive texts, G statistic, and the
#: part of the largest possible lift, 1 / prior.
GRAMS, LEVELS, FEATURES, LEAST, SIGNAL, LIFT = (5, 6, 7, 8), (1, 2, 4, 8), 3_000, 3, 20.0, 0.5
#: Optimiser: steps, rate and weight decay.
STEPS, RATE, DECAY = 600, 0.1, 1e-5
OUT = "doc_id long, held_out boolean, score double, predicted int"

_WORD = re.compile(r"[^\W\d_]+")
_built: dict[str, tuple] = {}


def marked(text: str) -> str:
    """Lower-cased runs of letters with one blank around each."""
    return f" {' '.join(_WORD.findall(text.lower()))} "


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text the distinct words, and a min-hash of its three-word shingles that copies with edits tend to share."""
    for part in slices(batches):
        hashes, _, _, rows = word_hashes(*text_bytes(part.column("text")), BLANK_LOWER)
        grams, whole = gram_hashes(hashes, rows, 3)
        least = np.full(part.num_rows, np.iinfo(np.uint64).max)
        np.minimum.at(least, rows[: len(grams)][whole], grams[whole])
        words = [sorted(set(_WORD.findall(t.lower()))) for t in part.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("positive"), part.column("text"), pa.array(words, pa.list_(pa.string())), pa.array(signed(least))],
            ["doc_id", "positive", "text", "words", "copies"],
        )


def training_sample(docs: DataFrame, labels: DataFrame, folds: int = 5) -> tuple[DataFrame, float]:
    """(positive, text, words) of the bounded sample, and the class prior; held-out documents give neither text nor label.

    The sample is drawn from the ids; only its texts are read then, and those that are null drop out.

    The prior is the share of toxic among all labelled training documents. Of texts that share a min-hash one stays, so that
    a large group of copies counts once.
    """
    allowed = docs.where(F.col("doc_id").isNotNull() & (remainder("doc_id", folds) != 0))
    marks = labels.where(F.col("toxic").isNotNull() & (remainder("doc_id", folds) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ship(docs.sparkSession)
    prior = marks.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] or 0.0
    ids = allowed.select("doc_id")
    toxic = hash_sample(ids.join(marks.where("toxic = 1"), "doc_id", "left_semi"), "doc_id", POSITIVES, "p")
    other = hash_sample(ids, "doc_id", UNLABELLED, "u")
    chosen = cut(toxic.withColumn("positive", F.lit(True)).unionByName(other.withColumn("positive", F.lit(False))).distinct())  # ids may repeat
    picked = allowed.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")  # bounded by the sample's parameters
    read = picked.mapInArrow(_words, "doc_id long, positive boolean, text string, words array<string>, copies long")
    firsts = read.groupBy("positive", "copies").agg(F.min_by(F.struct("text", "words"), F.struct("doc_id", "text")).alias("kept"))
    return cut(firsts.select("positive", "kept.text", "kept.words")), float(prior)


def select_features(sample: DataFrame, prior: float) -> list[str]:
    """The words and word beginnings, blanks included, whose share among positives stands out most over the negatives' share.

    The negatives' share is the unlabelled one less what the prior says positives add to it.
    """
    sizes = {r["positive"]: r["count"] for r in sample.groupBy("positive").count().collect()}
    n_pos, n_other = sizes.get(True, 0), sizes.get(False, 0)
    if not n_pos or not n_other or not 0 < prior < 1:
        return []
    words = sample.select("positive", F.explode("words").alias("word")).groupBy("word").agg(
        F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u")
    )
    held = F.concat(F.lit(" "), F.col("word"), F.lit(" "))

    exploded = words.select("p", "u", F.explode(F.array_distinct(F.array(held, *[F.substring(held, 1, n) for n in GRAMS]))).alias("gram"))
    counts = exploded.groupBy("gram").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).where(F.col("p") >= LEAST)
    in_p, in_u = F.col("p") / n_pos, (F.col("u") + 0.5) / n_other
    rated = counts.withColumn("lift", in_p / in_u).withColumn("signal", 2 * F.col("p") * F.ln("lift"))
    kept = rated.where((F.col("signal") >= SIGNAL) & (F.col("lift") >= LIFT / prior) & (F.length("gram") >= 4))
    return [r["gram"] for r in kept.orderBy(F.desc("signal"), "gram").limit(FEATURES).collect()]


def automaton(features: list[str]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for k, gram in enumerate(features):
        out.add_word(gram, k)
    if features:
        out.make_automaton()
    return out


def present(matcher, text: str) -> list[int]:
    """Levels reached: feature k with its j-th count is k * len(LEVELS) + j."""
    counts = Counter(k for _, k in matcher.iter(marked(text))) if len(matcher) else {}
    return sorted(k * len(LEVELS) + j for k, n in counts.items() for j, least in enumerate(LEVELS) if n >= least)


def _matrix(batches: Iterator[pa.RecordBatch], features: list[str]) -> Iterator[pa.RecordBatch]:
    matcher = automaton(features)
    for part in slices(batches):
        at = [present(matcher, t) for t in part.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("positive"), pa.array(at, pa.list_(pa.int32()))], ["positive", "at"])


def fit(rows: list[tuple[bool, list[int]]], n: int, prior: float) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise the non-negative risk: prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))."""
    weights, bias = np.zeros(n + 1), 0.0
    positive = np.array([p for p, _ in rows], bool)
    if not rows or positive.all() or not positive.any() or not 0 < prior < 1:
        return weights[:n], -20.0
    row = np.repeat(np.arange(len(rows)), [len(at) + 1 for _, at in rows])
    at = np.concatenate([np.array([*at, n]) for _, at in rows])  # feature n is the intercept
    n_pos, n_other = positive.sum(), (~positive).sum()
    weights[n] = start = np.log(prior / (1 - prior))
    first, second, best = np.zeros(n + 1), np.zeros(n + 1), (np.inf, weights.copy())
    for step in range(1, STEPS + 1):
        z = np.bincount(row, weights[at], len(rows))
        s = 1 / (1 + np.exp(-z))
        negative_risk = np.logaddexp(0, z[~positive]).sum() / n_other - prior * np.logaddexp(0, z[positive]).sum() / n_pos
        # Clipping can't tell an overfitted negative risk from none, so the steps are compared by its distance from 0.
        risk = prior * np.logaddexp(0, -z[positive]).sum() / n_pos + abs(negative_risk)
        if risk < best[0]:
            best = (risk, weights.copy())
        corrected = np.where(positive, -prior * s / n_pos, s / n_other)
        # Below 0 the negatives' risk is overfitted: the step goes back up on it alone.
        slope = np.where(positive, prior * (s - 1) / n_pos, 0.0) + corrected if negative_risk >= 0 else -corrected
        grad = np.bincount(at, slope[row], n + 1) + DECAY * np.append(weights[:n], 0)
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        weights -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
        weights[n] = min(weights[n], start)  # a text without features is no likelier toxic than the prior says
    return best[1][:n], float(best[1][n])


def train(docs: DataFrame, labels: DataFrame, folds: int = 5) -> tuple[list[str], np.ndarray, float]:
    sample, prior = training_sample(docs, labels, folds)
    features = select_features(sample, prior)

    def matrix(batches):
        return _matrix(batches, features)

    rows = [(r["positive"], r["at"]) for r in sample.select("positive", "text").mapInArrow(matrix, "positive boolean, at array<int>").collect()]
    rows.sort(key=lambda r: (r[0], r[1]))
    size = len(features) * len(LEVELS)
    # Selection added up words; counted by text, each level has to stand out on its own.
    p, u = (np.bincount(np.array([k for q, at in rows if q is side for k in at], int), minlength=size) for side in (True, False))
    n_pos = max(1, sum(q for q, _ in rows))
    lift = (p / n_pos) / ((u + 0.5) / max(1, len(rows) - n_pos))
    kept = (p >= LEAST) & (lift >= LIFT / max(prior, 1e-9)) & (2 * p * np.log(np.maximum(lift, 1)) >= SIGNAL)
    weights, bias = fit([(q, [k for k in at if kept[k]]) for q, at in rows], size, prior)
    return features, np.where(kept, weights, 0.0), bias


def _scores(batches: Iterator[pa.RecordBatch], shared) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    matcher, weights, bias = built(shared, lambda model: (automaton(model[0]), *model[1:]), _built)
    for part in slices(batches):
        logits = np.full(part.num_rows, bias)
        for row, text in enumerate(part.column("text").to_pylist()):
            if text:
                logits[row] += weights[present(matcher, text)].sum()
        yield part, 1 / (1 + np.exp(-np.clip(logits, -500, 500)))


def _scored(batches: Iterator[pa.RecordBatch], shared, folds: int) -> Iterator[pa.RecordBatch]:
    for part, scores in _scores(batches, shared):
        held = [None if i is None else zlib.crc32(str(i).encode()) % folds == 0 for i in part.column("doc_id").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(held, pa.bool_()), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
            ["doc_id", "held_out", "score", "predicted"],
        )


def score_toxicity(docs: DataFrame, model: tuple[list[str], np.ndarray, float], folds: int = 5) -> DataFrame:
    """Score and decision for every whole text of (doc_id long, text); one row per input row, repeated rows included.

    A null or empty text gets the score of a text without features; held_out is null for a null doc_id; a model without
    training data scores about 0; other columns are ignored; an empty table gives no rows. The score sees the text alone.
    """
    ship(docs.sparkSession)
    shared = share(docs.sparkSession, model)  # at most FEATURES entries

    def run(batches):
        return _scored(batches, shared, folds)

    return docs.select("doc_id", "text").mapInArrow(run, OUT)


def drop_toxic(docs: DataFrame, model: tuple[list[str], np.ndarray, float]) -> DataFrame:
    """The rows of (text, ...) with a score below 0.5, whole and with all their columns; nulls as in ``score_toxicity``."""
    ship(docs.sparkSession)
    shared = share(docs.sparkSession, model)

    def run(batches):
        for part, scores in _scores(batches, shared):
            yield part.filter(pa.array(scores < 0.5))

    return plain(docs).mapInArrow(run, docs.schema)
