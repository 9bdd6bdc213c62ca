"""Each stage of the pipeline against brute force, on its own input."""

import corpus_pipeline
from pyspark.sql import functions as F

from .test_line_dedup import WORD
from .test_line_dedup import brute as brute_lines
from .test_near_dedup import brute as brute_near
from .test_text_operators import brute_hits

SIZE = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SIZE}/documents.parquet")
    twins = docs.where("doc_id < 20").withColumn("doc_id", F.col("doc_id") + 100_000)
    docs = docs.unionByName(twins).cache()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line_dedup", "near_dedup", "decontamination", "mixing"]
    held, columns = {r.doc_id: r for r in docs.collect()}, docs.columns

    def step(name, frame):
        out = stages[name](spark, frame, SIZE).cache()
        return out, {r.doc_id: r for r in out.collect()}

    toxic, kept = step("toxicity", docs)
    assert toxic.columns == columns and all(kept[k] == held[k] for k in kept)
    assert 0.8 * len(held) < len(kept) < len(held)

    lines, left = step("line_dedup", toxic)
    want = brute_lines([(r.doc_id, r.text) for r in kept.values()], 50)
    assert lines.columns == columns
    for (i, text), words in want.items():
        before = WORD.findall(text)
        if before and not words:
            assert i not in left
        else:
            assert WORD.findall(left[i].text) == words and (len(words) < len(before) or left[i] == kept[i])
    assert any(k >= 100_000 for k in kept) and len(left) < len(kept)

    near, one = step("near_dedup", lines)
    groups = brute_near([(r.doc_id, r.text) for r in left.values()], 5, (4, 5))[1]
    assert near.columns == columns and set(one) == set(groups.values()) and all(one[k] == left[k] for k in one)

    clean, rest = step("decontamination", near)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SIZE}/benchmark.parquet").collect()]
    hits = {k: brute_hits(r.text, items)[:2] for k, r in one.items()}
    assert clean.columns == columns and set(rest) == {k for k, (n, hit) in hits.items() if not (hit and 20 * hit >= n)}

    mix = stages["mixing"](spark, clean, SIZE).collect()
    assert {r.doc_id for r in mix} == set(rest)
    for source in {r.source for r in mix}:
        of = [r for r in mix if r.source == source]
        assert sum(r.words for r in of) == sum({r.doc_id: r.taken for r in of}.values()) == round(of[0].target)
    at = [2 if r.position is None else r.position for r in mix]
    assert at == sorted(at)


def test_run_and_edges(spark):
    assert corpus_pipeline.run(spark, SIZE).count() > 100
    odd = spark.createDataFrame(
        [(None, None, None, None, None, 1), (1, None, None, None, None, 2), (2, "", "en", "s", 0, 3), (3, "x " * 100_000, None, None, 5, 4), (4, "tie", "en", "s", 3, 5), (4, "tie", "en", "s", 3, 5)],
        "doc_id long, text string, lang string, source string, n_chars long, extra int",
    )
    clash = odd.withColumns({c: F.lit(c) for c in NAMES})
    for frame in (odd, odd.limit(0), clash):
        out = frame
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, SIZE)
            assert out.columns == frame.columns, name
        rows = out.collect()
        assert all(r[c] == c for r in rows for c in NAMES if c in frame.columns)
        mixed = corpus_pipeline.STAGES[-1][1](spark, out, SIZE).collect()
        assert sorted({str(r.doc_id) for r in mixed}) == sorted({str(r.doc_id) for r in rows}) and len(mixed) >= len(rows)
        assert all(r[c] == c for r in mixed for c in NAMES if c in frame.columns)


#: Every name that an operator gives a column of its own.
NAMES = (
    "n_words N_removed part later own mixed at reach least full hash n_hit n_items items spans runs contaminated size source_size target taken copies epoch words position copy key "
    "component component_id kept n node check registers band split leader task side shingles n_shingles positive score predicted toxic rank rest held count before source_ "
    "__n_words __n_removed __t __part __later __own __mixed __runs __items __z __h __s __b __before __size __target __rank __at __whole __rest __source __copy __key __c0 a.b odd`name"
).split()


def test_repeated_rows_go_once(spark):
    text = "one two three four five six seven"
    rows = [(1, text), (1, text), (1, "eight nine ten eleven twelve thirteen"), (2, text), (None, text), (None, text), (3, None), (3, None)]
    out = corpus_pipeline.dedup_near(spark, spark.createDataFrame(rows, "doc_id long, text string"), SIZE)
    assert sorted(map(tuple, out.collect()), key=str) == sorted([*rows[1:3], *rows[4:]], key=str)
