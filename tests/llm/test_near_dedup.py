import random
import re

import numpy as np
import pytest

from tidemark.llm import components as components_module
from tidemark.llm import near_dedup
from tidemark.llm.components import components
from tidemark.llm.near_dedup import near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, n_shingles string"


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def groups(links, nodes):
    least = {n: n for n in nodes}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        least[b] = a
    return {n: root(n) for n in nodes}


def brute(rows, k, share):
    sets = {i: shingles(t, k) for i, t in rows}
    ids = sorted(sets)
    links = [
        (a, b)
        for x, a in enumerate(ids)
        for b in ids[x + 1 :]
        if sets[a] and sets[b] and share[1] * len(sets[a] & sets[b]) >= share[0] * len(sets[a] | sets[b])
    ]
    return sets, groups(links, ids)


def corpus(rng, n_groups=12, most=30, alone=60):
    vocabulary = [f"W{i}" for i in range(300)] + ["é", "Ñ"]
    rows, i = [], 0
    for _ in range(n_groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, most)):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((i, "  ".join(words)))
            i += 1
    for _ in range(alone):
        rows.append((i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))))
        i += 1
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(order[k], t) for k, (_, t) in enumerate(rows)]


def compare(spark, rows, k, share):
    sets, want = brute(rows, k, share)
    got = near_duplicates(spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA), k, share).collect()
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in rows)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    return want


def test_against_brute_force(spark):
    want = compare(spark, corpus(random.Random(1)), 3, (17, 20))
    assert len(set(want.values())) < len(want) - 30
    compare(spark, corpus(random.Random(2), 6, 10, 20), 5, (4, 5))


def test_large_buckets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    compare(spark, corpus(random.Random(3), 4, 60, 10), 3, (17, 20))


def section_corpus(rng, n, shared, pool, own, copies=30):
    """Texts of shared sections and ``own`` ones of a pool, hardly any linked, and a group of near copies."""
    section = lambda: [f"s{rng.randrange(10**6)}" for _ in range(40)]
    common, more = [section() for _ in range(shared)], [section() for _ in range(pool)]
    rows = [(i, " ".join(w for part in [*common, *rng.sample(more, own)] for w in part)) for i in range(n)]
    base = [w for part in [*common, *(section() for _ in range(own))] for w in part]
    for i in range(n, n + copies):
        words = list(base)
        words[rng.randrange(len(words))] = "edit"
        rows.append((i, " ".join(words)))
    return rows


def test_large_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    monkeypatch.setattr(near_dedup, "OUTSIDE", 1)
    calls = []
    real = near_dedup.bucket_tasks

    def bucket_tasks(rows, classes, share, splits=True):
        calls.append(splits)
        return real(rows, classes, share, splits)

    monkeypatch.setattr(near_dedup, "bucket_tasks", bucket_tasks)
    want = compare(spark, section_corpus(random.Random(5), 90, 7, 1000, 1), 5, (4, 5))
    assert False in calls and len(set(want.values())) < len(want) - 25


def test_hot_buckets_are_broadcast(spark, monkeypatch):
    from tidemark.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 5)
    monkeypatch.setattr(common, "HOT_BITS", 60)
    compare(spark, corpus(random.Random(6), 3, 40, 10), 3, (17, 20))


def test_edges(spark):
    text = "One two three four five six"
    rows = [(5, text, None), (5, text, "again"), (3, text.upper(), None), (None, text, None), (8, None, None), (9, " \n", None), (10, "one two", None), (2, "ONE\ttwo", None), (11, "one two x" + "y z " * 40_000, None)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, SCHEMA), 3).collect()), key=str)
    assert got == sorted(
        [(5, 4, 3, False)] * 2 + [(3, 4, 3, True), (None, 4, None, True), (8, 0, 8, True), (9, 0, 9, True), (10, 1, 2, False), (2, 1, 2, True), (11, 5, 11, True)],
        key=str,
    )
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_estimate_follows_the_similarity():
    rng = np.random.default_rng(0)
    for shared, own_a, own_b in ((800, 100, 100), (300, 300, 300), (850, 150, 0)):
        every = rng.integers(0, 2**63, shared + own_a + own_b).astype(np.uint64)
        a, b = every[: shared + own_a], np.concatenate((every[:shared], every[shared + own_a :]))
        x, y = near_dedup.registers_of([a, b])
        got = near_dedup.estimate(*(np.array([v]) for v in (len(a), len(b), (x > y).sum(), (x < y).sum(), (x == y).sum())))[0]
        assert abs(got - shared / len(every)) < 0.12
    merged = near_dedup.registers_of([np.concatenate((a, b))])[0]
    assert (merged == np.maximum(x, y)).all()


@pytest.mark.parametrize("last", [250_000, 40, 0])
def test_components(spark, monkeypatch, last):
    monkeypatch.setattr(components_module, "LAST", last)
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + k) for k in range(1, 50)]
    edges += [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(7, 7), (3, 2)]
    want = groups(edges, {x for e in edges for x in e if e[0] != e[1]})
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert components(spark.createDataFrame([(None, 1), (4, 4)], "a long, b long")).count() == 0
