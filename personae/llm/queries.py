"""One query for each operator of this package, over the whole table it is meant for."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from personae.llm import (
    bpe, forest, hard_negatives, jaccard, langid, packing, pii, quality, secret_scan, source_audit,
    suffix_tree, token_files, topk,
)
from personae.llm.batches import remainder, table
from personae.operators.scale import materialize

TOKENIZER = "word_bpe_49k.json"


def tokenizer() -> str:
    return public_tokenizers.path(TOKENIZER)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer())


def op2_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the table, by tokens, into bins of 512 to 8192."""
    counts = packing.token_counts(table(spark, sf_dir, "documents"), tokenizer())
    return packing.pack(materialize(counts, "token-counts"))


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=20, divisor=20, scale=64)


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).drop("component")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), remainder("doc_id", 5) == 0
    model = quality.train(docs, table(spark, sf_dir, "labels"), where=~held_out)
    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    return quality.classify(rows, model).drop("text")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), remainder("doc_id", 4) == 2
    model = langid.train(docs, where=~held_out)
    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    return langid.identify(rows, model).drop("text")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), tokenizer())


def op8_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.nearest(table(spark, sf_dir, "embeddings"), k=5, divisor=50)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"), sharp=True)


def op10_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), remainder("doc_id", 5) == 1
    tree, words = suffix_tree.train(docs, where=~held_out)
    return suffix_tree.score(docs, tree, words, keep=["doc_id", held_out.alias("held_out")])


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 100th vector is an anchor; every 7th has a label that is one too high."""
    wrong = F.col("vec_id") % 7 == 0
    rows = table(spark, sf_dir, "embeddings").withColumn(
        "label", F.when(wrong, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    )
    return hard_negatives.mine(rows)


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.report(docs, pii.train(docs))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_best_fit": op2_best_fit,
    "op3_top_k": op3_top_k,
    "op4_jaccard": op4_jaccard,
    "op5_quality": op5_quality,
    "op6_language": op6_language,
    "op7_token_files": op7_token_files,
    "op8_hash_prefix_forest": op8_hash_prefix_forest,
    "op9_secrets": op9_secrets,
    "op10_suffix_tree": op10_suffix_tree,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_pii": op12_pii,
    "op13_source_audit": op13_source_audit,
}

SQL: dict[str, str] = {
    "op4_jaccard": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id,
                   list_filter(
                       regexp_split_to_array(
                           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                           '[\x20\x09-\x0D]+'),
                       lambda w: w <> '') AS w
            FROM documents
        ), sets AS (
            SELECT doc_id,
                   CASE WHEN len(w) = 0 THEN []
                        WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                   END AS s
            FROM words
        ), shingles AS (
            SELECT doc_id, unnest(s) AS shingle FROM sets
        ), shared AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
            FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
            GROUP BY ALL
        ), links AS (
            SELECT a, b FROM shared
            JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
            WHERE 100 * n >= 80 * (len(x.s) + len(y.s) - n)
        ), reach(doc_id, other) AS (
            SELECT doc_id, doc_id FROM sets
            UNION
            SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other
        )
        SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, min(reach.other) AS component_id
        FROM sets JOIN reach ON reach.doc_id = sets.doc_id
        GROUP BY sets.doc_id, len(s)
    """,
    "op3_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
            FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
    "op11_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
                   CAST(list_sum(list_transform(list_zip(a.w, c.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id AND len(a.w) = len(c.w)
        ), positives AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        )
        SELECT anchor_id, positive_id,
               CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
               vec_id AS negative_id, positive_score, score AS negative_score
        FROM positives JOIN scored USING (anchor_id)
        WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
    """,
    "op13_source_audit": r"""
        WITH docs AS (
            SELECT row_number() OVER () AS d, coalesce(text, '') AS text, coalesce(lang, '') AS lang,
                   coalesce(source, '') AS source
            FROM documents
        ), words AS (
            SELECT d, lang, source, unnest(regexp_extract_all(
                       translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM docs
        ), kept AS (
            SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT d) >= 10
        ), counts AS (
            SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS c FROM words JOIN kept USING (lang, term) GROUP BY ALL
        ), groups AS (
            SELECT DISTINCT lang, source FROM docs
        ), sizes AS (
            SELECT lang, source, (SELECT count(*) FROM kept k WHERE k.lang = g.lang) AS v,
                   (SELECT coalesce(sum(c), 0) FROM counts n WHERE n.lang = g.lang AND n.source = g.source) AS n,
                   (SELECT coalesce(sum(c), 0) FROM counts n WHERE n.lang = g.lang) AS lang_n
            FROM groups g
        ), shares AS (
            SELECT s.lang, s.source, k.term, coalesce(c.c, 0) AS c,
                   1 + (1000000000 * (coalesce(c.c, 0) + 2)) // (s.n + 2 * s.v) AS p,
                   1 + (1000000000 * (sum(coalesce(c.c, 0)) OVER (PARTITION BY s.lang, k.term) + 2)) // (s.lang_n + 2 * s.v) AS q
            FROM sizes s JOIN kept k USING (lang)
            LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
        ), pairs AS (
            SELECT a.lang, a.source, b.source AS item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)), 0) AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source
            LEFT JOIN shares y ON y.lang = a.lang AND y.source = b.source AND y.term = x.term
            GROUP BY ALL
        ), both_parts AS (
            SELECT lang, source, 'pair' AS part, item, value FROM pairs
            UNION ALL
            SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM shares WHERE c > 0 AND p > q
        )
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
               CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
        FROM both_parts
        QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 10
    """,
}
