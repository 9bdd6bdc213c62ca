"""The registered queries of this folder, and their SQL where SQL can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, decontaminate, embedding_dedup, language_id, line_dedup, mixing, near_dedup, token_counts, toxicity, url_filter
from .common import cut, table

#: Paths of the tokenizer files on every executor; by default those of the installed package.
BYTE_BPE, PIECE_BPE = os.environ.get("BYTE_BPE_JSON", ""), os.environ.get("PIECE_BPE_MODEL", "")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), k=3, share=(17, 20))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), BYTE_BPE or _vocabulary("byte_bpe_50k.json"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text")
    ordered = cut(mixing.training_order(mix, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return mixing.mixed_documents(ordered)


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.chat_digest(chat_format.format_chat(turns))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs, language_id.vocabulary(PIECE_BPE or _vocabulary("piece_bpe_32k.model")))
    return language_id.identify(docs, model)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights, intercept = url_filter.train(url_filter.labelled_urls(spark))
    judged = url_filter.filter_urls(table(spark, sf_dir, "pages"), weights, intercept)
    return judged.select("page_id", "host", "path", "rule", "verdict")


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_minhash_dedup,
        op3_embedding_dedup,
        op4_token_counts,
        op5_mix_sources,
        op6_chat_format,
        op7_language_id,
        op8_toxicity,
        op9_decontaminate,
        op10_url_filter,
    )
}

ORACLE_SQL = {
    "op2_minhash_dedup": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 2], ' ') AS g
              FROM d, LATERAL unnest(range(1, greatest(2, len(w) - 1))) AS t(k) WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * i >= 85 * (x.n + y.n - i)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT e.b, r.c FROM r JOIN e ON r.doc_id = e.a),
        m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
        FROM d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op3_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, CASE WHEN label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                   AND list_max(list_transform(embedding, lambda x: abs(x))) > 0 THEN embedding::DOUBLE[] END AS e FROM embeddings),
        l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
              WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
        r AS (SELECT vec_id, vec_id AS c FROM v UNION SELECT l.b, r.c FROM r JOIN l ON r.vec_id = l.a),
        m AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id),
        n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
        SELECT v.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept
        FROM v JOIN m USING (vec_id) LEFT JOIN n ON n.a = v.vec_id""",
    "op5_mix_sources": """
        WITH d AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
                   md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS h FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS kind FROM s),
        r AS (SELECT *, [1.0::DOUBLE, 2.0::DOUBLE, 3.0::DOUBLE][1 + kind] AS weight, source_size * 3 / weight AS ratio FROM w),
        l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER b, 0))
                        / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
              FROM r WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        f AS (SELECT max(level) AS final FROM l WHERE level <= ratio),
        t AS (SELECT source, source_size, kind, CASE WHEN ratio < final THEN (source_size * 3)::DOUBLE ELSE final * weight END AS target FROM l, f),
        p AS (SELECT d.*, t.source_size, t.kind, t.target, round(t.target)::BIGINT AS demand,
                     coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        -- Copy e of a document stands e * source_size + before words into its source's stream, which ends at the demand.
        e AS (SELECT *, CASE WHEN size > 0 AND before < demand THEN (demand - 1 - before) // source_size + 1 ELSE 0 END AS n_copies FROM p),
        -- The schedules run through weights 2, 1, 0.5 (integral 0.75 + 0.375), 1, 1 (integral 1), and 0.5, 1, 2 (integral 0.375 + 0.75) at equal times.
        a AS (SELECT *, [1.125::DOUBLE, 1.0::DOUBLE, 1.125::DOUBLE][1 + kind] AS whole,
                     least(1.0::DOUBLE, before / greatest(demand, 1)) * whole AS x,
                     least(1.0::DOUBLE, ((n_copies - 1) * source_size + before) / greatest(demand, 1)) * whole AS y FROM e)
        SELECT doc_id, size, source_size, target,
               CASE WHEN source_size = 0 THEN 0 ELSE (demand // source_size) * size
                    + greatest(0, least(size, demand % source_size - before)) END::BIGINT AS taken,
               n_copies::BIGINT AS n_copies,
               CASE WHEN n_copies = 0 THEN NULL ELSE least(1.0::DOUBLE, CASE
                    WHEN kind = 0 AND x < 0.75 THEN 2 * x / (2.0::DOUBLE + sqrt(greatest(0, 4.0::DOUBLE - 4.0::DOUBLE * x)))
                    WHEN kind = 0 THEN 0.5::DOUBLE + 2 * (x - 0.75::DOUBLE) / (1.0::DOUBLE + sqrt(greatest(0, 1.0::DOUBLE - 2.0::DOUBLE * (x - 0.75::DOUBLE))))
                    WHEN kind = 1 THEN 2 * x / (1.0::DOUBLE + sqrt(1.0::DOUBLE))
                    WHEN x < 0.375 THEN 2 * x / (0.5::DOUBLE + sqrt(greatest(0, 0.25::DOUBLE + 2.0::DOUBLE * x)))
                    ELSE 0.5::DOUBLE + 2 * (x - 0.375::DOUBLE) / (1.0::DOUBLE + sqrt(greatest(0, 1.0::DOUBLE + 4.0::DOUBLE * (x - 0.375::DOUBLE)))) END) END AS first_position,
               CASE WHEN n_copies = 0 THEN NULL ELSE least(1.0::DOUBLE, CASE
                    WHEN kind = 0 AND y < 0.75 THEN 2 * y / (2.0::DOUBLE + sqrt(greatest(0, 4.0::DOUBLE - 4.0::DOUBLE * y)))
                    WHEN kind = 0 THEN 0.5::DOUBLE + 2 * (y - 0.75::DOUBLE) / (1.0::DOUBLE + sqrt(greatest(0, 1.0::DOUBLE - 2.0::DOUBLE * (y - 0.75::DOUBLE))))
                    WHEN kind = 1 THEN 2 * y / (1.0::DOUBLE + sqrt(1.0::DOUBLE))
                    WHEN y < 0.375 THEN 2 * y / (0.5::DOUBLE + sqrt(greatest(0, 0.25::DOUBLE + 2.0::DOUBLE * y)))
                    ELSE 0.5::DOUBLE + 2 * (y - 0.375::DOUBLE) / (1.0::DOUBLE + sqrt(greatest(0, 1.0::DOUBLE + 4.0::DOUBLE * (y - 0.375::DOUBLE)))) END) END AS last_position
        FROM a""",
    "op6_chat_format": r"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
            UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e AS (
            SELECT *, regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\]|/?SYS\]|/?ROLE\]|END\]|TURN\])', '\1\\\2\3', 'g') AS safe,
                   lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM c),
        n AS (
            SELECT *, length(safe) + CASE
                WHEN before = role THEN 6
                WHEN role = 'user' THEN 13 WHEN role = 'assistant' THEN 7 WHEN role = 'system' THEN 11
                ELSE 18 + length(regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\]|/?SYS\]|/?ROLE\]|END\]|TURN\])', '\1\\\2\3', 'g')) END AS chars
            FROM e)
        SELECT conv_id, count(*)::BIGINT AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(chars)::BIGINT AS formatted_chars
        FROM n GROUP BY conv_id""",
    "op9_decontaminate": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        i AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[k:k + least(13, len(w)) - 1], ' ') AS g
              FROM b, LATERAL unnest(range(1, greatest(2, len(w) - 11))) AS t(k) WHERE len(w) > 0),
        ns AS (SELECT DISTINCT n FROM i),
        g AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS g
              FROM d, ns, LATERAL unnest(range(1, len(w) - n + 2)) AS t(k) WHERE len(w) >= n),
        m AS (SELECT doc_id, k, i.n, item_id FROM g JOIN i ON g.n = i.n AND g.g = i.g),
        h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM m, LATERAL unnest(range(k, k + n)) AS t(p) GROUP BY doc_id),
        f AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
              FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM m) GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN f USING (doc_id)""",
}
