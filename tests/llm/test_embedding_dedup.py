import numpy as np

from tidemark.llm import embedding_dedup
from tidemark.llm.embedding_dedup import near_vectors

from .test_near_dedup import groups

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def brute(rows, threshold):
    usable = {}
    for i, v, label in rows:
        if v is None or label is None or any(x is None for x in v):
            continue
        x = np.array(v, np.float64)
        if len(x) and np.isfinite(x).all() and x.any():
            usable[i] = (label, x / np.linalg.norm(x))
    ids = sorted(usable)
    links = [
        (a, b)
        for k, a in enumerate(ids)
        for b in ids[k + 1 :]
        if usable[a][0] == usable[b][0] and len(usable[a][1]) == len(usable[b][1]) and usable[a][1] @ usable[b][1] >= threshold
    ]
    counts = dict.fromkeys((i for i, *_ in rows), 0)
    for a, b in links:
        counts[a] += 1
        counts[b] += 1
    return counts, groups(links, counts)


def data(seed, n, clusters, dim=16):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.standard_normal(dim).astype(np.float32).tolist(), int(i % 3)) for i in range(n)]
    for _ in range(clusters):
        base = rng.standard_normal(dim)
        label = int(rng.integers(3))
        for _ in range(int(rng.integers(2, 60))):
            rows.append((len(rows), (base + 0.1 * rng.random() * rng.standard_normal(dim)).astype(np.float32).tolist(), label))
        rows += [(len(rows) + k, rows[-1][1], label) for k in range(3)]
    return rows


def compare(spark, rows):
    counts, want = brute(rows, 0.98)
    got = near_vectors(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()
    assert len(got) == len(rows)
    wrong = [r for r in got if (r.n_links, r.component_id, r.kept) != (counts[r.vec_id], want[r.vec_id], want[r.vec_id] == r.vec_id)]
    assert not wrong, wrong[:5]


def test_against_brute_force(spark):
    compare(spark, data(0, 600, 12))


def test_clusters_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CLUSTER_BLOCK", 5)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    compare(spark, data(1, 60, 5))


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], 0, "a"), (2, [2.0, 4.0], 0, "b"), (3, [1.0, 2.0], 1, "c"), (4, [1.0, 2.0], None, "d"), (5, None, 0, "e"), (6, [0.0, 0.0], 0, "f"), (7, [nan, 1.0], 0, "g"), (8, [inf, 1.0], 0, "h"), (9, [None, 2.0], 0, "i"), (10, [], 0, "j"), (11, [1.0, 2.0, 0.0], 0, "k"), (None, [1.0, 2.0], 0, "l"), (1, [1.0, 2.0], 0, "m"), (12, [3e38, 3e38], 5, "n"), (13, [1e-38, 1e-38], 5, "o")]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    want = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11)] + [(None, 0, None, True), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (12, 1, 12, True), (13, 1, 12, False)]
    assert got == sorted(want, key=str)
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def clumps(rng, dim, angle, spread, sizes):
    """Two clumps of distinct near copies whose centres are ``angle`` apart."""
    a = np.linalg.qr(rng.standard_normal((dim, 2)))[0].T
    centres = [a[0], np.cos(angle) * a[0] + np.sin(angle) * a[1]]
    return [(c + spread * rng.standard_normal(dim) / np.sqrt(dim)).tolist() for c, n in zip(centres, sizes, strict=True) for _ in range(n)]


def test_links_between_saturated_clumps(spark):
    rng = np.random.default_rng(7)
    vectors = clumps(rng, 32, np.arccos(0.98), 0.004, (100, 100)) + rng.standard_normal((100, 32)).tolist()
    rows = [(i, np.float32(v).tolist(), 0) for i, v in enumerate(vectors)]
    counts, want = brute(rows, 0.98)
    assert len({want[i] for i in range(200)}) == 1 and all(counts[i] >= 99 for i in range(200)) and max(counts.values()) > 110
    got = {r.vec_id: r for r in near_vectors(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()}
    assert [(got[i].n_links, got[i].component_id) for i in range(200)] == [(counts[i], want[i]) for i in range(200)]


def groups_and_pairs(seed):
    """A group of 120, 20 pairs and 40 others of one label; the group's ids come first."""
    rng = np.random.default_rng(seed)
    near = lambda n, base: [base + 0.005 * rng.standard_normal(16) for _ in range(n)]
    vectors = near(120, rng.standard_normal(16)) + [v for _ in range(20) for v in near(2, rng.standard_normal(16))]
    return [(i, np.float32(v).tolist(), 0) for i, v in enumerate([*vectors, *rng.standard_normal((40, 16))])]


def test_audit_sees_lost_pairs(spark, monkeypatch):
    real, calls = embedding_dedup.descend, []

    def descend(graph, classes, *more):
        calls.append(1)
        if len(calls) > 1:
            return real(None, classes, *more)
        group = classes.where("least < 120").select("node")
        return group.crossJoin(group.toDF("near")).where("node <> near").selectExpr("node", "near", "1.0D as sim", "true as fresh")

    monkeypatch.setattr(embedding_dedup, "descend", descend)
    rows = groups_and_pairs(3)
    counts, want = brute(rows, 0.98)
    got = near_vectors(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()
    assert sum(counts.values()) == 120 * 119 + 20 * 2
    assert all((r.n_links, r.component_id) == (counts[r.vec_id], want[r.vec_id]) for r in got)


def test_last_attempt_is_audited(spark, monkeypatch):
    """A descent that never finds anything; every label is compared whole in the end."""

    def descend(graph, classes, *more):
        return embedding_dedup.cut(classes.selectExpr("node", "node as near", "1.0D as sim", "true as fresh").limit(0))

    monkeypatch.setattr(embedding_dedup, "descend", descend)
    monkeypatch.setattr(embedding_dedup, "WHOLE", 0, raising=False)
    rows = groups_and_pairs(4)
    counts, want = brute(rows, 0.98)
    got = near_vectors(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()
    assert all((r.n_links, r.component_id) == (counts[r.vec_id], want[r.vec_id]) for r in got)
