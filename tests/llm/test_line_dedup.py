import random
import re

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm.line_dedup import dedup_lines

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, hash string"


def brute(rows, run):
    """Every window of ``run`` words whose first occurrence is elsewhere goes, but for that occurrence's own words."""
    docs = sorted({(i, t) for i, t, *_ in rows if i is not None and t is not None})
    first, gone = {}, {}
    for i, t in docs:
        words = WORD.findall(t)
        for s in range(len(words) - run + 1):
            w = tuple(words[s : s + run])
            if w not in first or first[w][0] == i and first[w][2] != t:
                first.setdefault(w, (i, s, t))
    for i, t in docs:
        words = WORD.findall(t)
        mark = [False] * len(words)
        home = {}
        for s in range(len(words) - run + 1):
            w = tuple(words[s : s + run])
            if first[w][0] < i:
                start = s
            else:
                home.setdefault(w, s)
                if home[w] == s:
                    continue
                start = max(s, home[w] + run)
            for k in range(start, s + run):
                mark[k] = True
        gone[i, t] = [w for w, m in zip(words, mark, strict=True) if not m]
    return gone


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "ñandú", "\x00"]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(6, 40))] for _ in range(12)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randint(0, 6)):
            if rng.random() < 0.6:
                p = list(rng.choice(passages))
                if rng.random() < 0.3:
                    p[rng.randrange(len(p))] = "edit"
                words += p[rng.randint(0, 3) :]
            else:
                words += [rng.choice(vocabulary) for _ in range(rng.randint(1, 20))]
        text = "".join(w + rng.choice([" ", "  ", "\n", "\t"]) for w in words)
        rows.append((i, text, "x"))
    rows.append((200, "a " * 60, None))
    rows.append((201, " ".join(str(k % 9) for k in range(70)), None))
    rows += [rows[5], rows[7]]
    got = dedup_lines(spark.createDataFrame(rows, SCHEMA), run=8, gram=4).collect()
    expected = brute(rows, 8)
    assert len(got) == len(rows)
    source = {i: t for i, t, _ in rows}
    changed = 0
    for r in got:
        want = expected[r.doc_id, source[r.doc_id]]
        assert WORD.findall(r.text) == want, r.doc_id
        n = len(WORD.findall(source[r.doc_id]))
        assert (r.n_words, r.n_removed) == (n, n - len(want))
        if n == len(want):
            assert r.text == source[r.doc_id]
        else:
            changed += 1
    assert changed > 20


def test_edges(spark):
    long = " ".join(np.random.default_rng(0).permutation(60).astype(str))
    rows = [(None, long, "n"), (1, None, "a"), (2, "", "b"), (3, f"x {long} y", "c"), (4, f"{long}", "d"), (5, f"p\n{long}\nq", "e"), (3, "other", "f")]
    got = {(r.doc_id, r.hash): r for r in dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    assert got[None, "n"].text == long and got[1, "a"].text is None and got[2, "b"].text == ""
    assert got[3, "c"].text == f"x {long} y" and got[3, "f"].text == "other"
    assert got[4, "d"].text == "" and got[5, "e"].text == "p\n\nq"
    assert dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_clashing_columns(spark):
    names = ("n_words", "N_removed", "part", "later", "own", "mixed", "at", "reach", "least", "full", "__part", "__later", "__own", "__n_words", "a.b`c")
    rows = [(1, "a " * 60), (1, "a " * 60), (2, "b " * 3), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in names})
    got = dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_words_", "n_removed_"]
    assert sorted((str(r.doc_id), r.text, r.n_removed_) for r in got.collect() if r.text) == [("1", "a " * 50, 10), ("1", "a " * 50, 10), ("2", "b " * 3, 0)]
    assert all(r[c] == "x" for r in got.collect() for c in names)


def test_repeated_rows_cost_their_number(spark):
    """Rows that share doc_id and text count once on the way to their repeats."""
    text = " ".join(f"w{k}" for k in range(400)) + " " + " ".join(f"w{k}" for k in range(100))
    docs = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    got = dedup_lines(docs).groupBy("n_removed", F.length("text")).count().collect()
    assert [tuple(r) for r in got] == [(100, len(text) - len(" ".join(f"w{k}" for k in range(100))) - 1, 3000)]


def test_hot_passage(spark):
    passage = " ".join(f"p{k}" for k in range(55))
    docs = spark.range(400).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("own"), F.col("id"), F.lit(f" {passage} tail"), F.col("id")).alias("text")
    )
    got = dedup_lines(docs)
    assert got.where("text like '%p3 p4%'").select("doc_id").collect() == [(0,)]
    assert got.where("doc_id = 7").first().text == "own7 tail7"
