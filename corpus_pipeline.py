"""The corpus pipeline: five stages, each one operator over all that the stage before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``docs``. Rows with a
null doc_id or text pass every filter; a stage over an empty table returns an empty one; columns beside doc_id, text and
source are carried along whatever their names (n_chars follows the text where it is there).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, line_dedup, mixing, near_dedup, toxicity
from tidemark.llm.common import columns, cut, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of 50 words or more go, and with them documents of which nothing is left."""
    cleaned = line_dedup.dedup_lines(docs)
    n_words, n_removed = columns(cleaned.columns[-2:])
    kept = dict(zip(docs.columns, columns(docs.columns), strict=True))
    if "n_chars" in kept:
        kept["n_chars"] = F.when(n_removed > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return cleaned.where((n_removed == 0) | (n_removed < n_words)).select(*[c.alias(name) for name, c in kept.items()])


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (5-word shingles, similarity 0.8) the document of least doc_id stays, and
    of rows that share doc_id and text one."""
    names = columns(docs.columns)
    judged = near_dedup.near_duplicates(docs, k=5, share=(4, 5))
    gone = cut(judged.where("not kept").select("doc_id").distinct())
    few = gone.count() <= near_dedup.BROADCAST_KEYS
    left = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*names)
    twice = cut(docs.where("doc_id is not null and text is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if twice.isEmpty():
        return left
    repeated = left.join(twice, "doc_id", "left_semi").select(*names)
    once = repeated.where("text is not null").dropDuplicates(["doc_id", "text"])
    return left.join(twice, "doc_id", "left_anti").select(*names).union(repeated.where("text is null")).union(once)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark items contaminate go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per copy of a document in the mix, in training order, and the documents of which nothing is taken last."""
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return mixing.training_order(mixing.mix_sources(docs), width)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_near),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
]

#: A trained classifier comes first, which SQL can't express; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
