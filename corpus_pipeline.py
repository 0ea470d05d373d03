"""A training corpus from documents: each stage's decisions hold for all that follow.

1. language: documents without an identifiable language go;
2. quality: documents that the classifier rejects go;
3. near_duplicates: one document of each group of near copies stays;
4. secrets: what the scan finds is masked;
5. packing: the documents become pieces of sequences.

``run`` applies the stages to ``documents``; every stage's result is written as Parquet and
read again. Stages return the columns of documents, the last one the places of all pieces.
Classifiers learn from rows with labels, as their queries do, and never see doc_id, lang or
source. Missing columns are not made up; extra columns do not survive the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from personae.llm import jaccard, langid, packing, quality, secret_scan
from personae.llm.batches import remainder, table
from personae.llm.queries import tokenizer
from personae.operators.scale import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# A text is in the language found for it if its n-grams are, on the mean, at most this much less
# probable (natural logarithm) than those of the language's training rows.
FAR = 2.75


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 6. Null, empty and letterless texts are undetermined and go; so do texts of other letters,
    scripts and languages, whose n-grams fit none of those learned."""
    model = langid.train(table(spark, sf_dir, "documents"), where=remainder("doc_id", 4) != 2)
    found = langid.identify(docs.select(*COLUMNS), model)
    kept = found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("fit") >= -FAR))
    return kept.select(*COLUMNS)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 5, with the threshold of its query."""
    model = quality.train(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
        where=remainder("doc_id", 5) != 0,
    )
    found = quality.classify(docs.select(*COLUMNS), model)
    return found.where("predicted = 1").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 4. The row with the smallest doc_id of each group stays, one row if ids repeat.

    Texts without a word link with nothing and stay.
    """
    # numbers follow the splits of a scan, which may differ from one scan to the next
    numbered = docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id())
    numbered = materialize(numbered, "numbered")
    groups = jaccard.join(numbered, keep=["_row"])
    alone = F.when(F.col("component").isNull(), F.col("_row"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))  # null ids last
    chosen = groups.groupBy("component", alone.alias("_alone")).agg(first.alias("first"))
    # as many rows as documents stay: no side of this join is small
    kept = materialize(chosen.select("first._row"), "near-duplicates").hint("merge")
    return numbered.join(kept, "_row", "left_semi").select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 9. Spans of any kind are masked; n_chars is the new length, null for null text."""
    found = secret_scan.scan(docs, keep=["doc_id", "lang", "source", "n_chars"], sharp=True)
    clean = found.withColumn("text", secret_scan.redacted("text", "spans"))
    changed = F.when(F.size("spans") > 0, F.length("text").cast("long"))
    return clean.select(
        "doc_id", "text", "lang", "source", F.coalesce(changed, "n_chars").alias("n_chars")
    )


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Op 2, by tokens."""
    counts = packing.token_counts(docs, tokenizer(), memory=100_000)
    return packing.pack(materialize(counts, "token-counts"))


STAGES = [
    ("language", language),
    ("quality", quality_filter),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("packing", pack),
]

# Naive Bayes, a neural network and best fit are beyond SQL; tests/llm holds a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
