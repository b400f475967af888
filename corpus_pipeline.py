"""From raw documents to packed training windows: toxicity, exact dedup, near duplicates, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from versionlake.llm.common import table, text_of, written
from versionlake.llm.exact_dedup import exact_groups
from versionlake.llm.jaccard import near_duplicates
from versionlake.llm.packing import pack
from versionlake.llm.pii import find_pii, redact
from versionlake.llm.toxicity import score_texts, train_models

#: Packing cuts by a tokenizer and the classifiers are trained, so SQL gives no such rows.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under 0.5, with all columns; null texts score as empty ones."""
    models = train_models(docs, table(spark, sf_dir, "labels"))
    return score_texts(docs, models).where("__score < 0.5").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest original, then the smallest doc_id.

    Null counts as the empty text. Of rows with the same doc_id and equal texts one stays: the longest text, then the last in
    the order of all columns, so that a task that runs again keeps the same row. An empty table gives no rows.
    """
    dropped = exact_groups(docs).where(~F.col("kept")).select(
        F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sum")).distinct()
    keyed = docs.withColumn("__digest", F.sha2(
        F.regexp_replace(text_of(docs), r"[\x20\x09-\x0D]+", "").cast("binary"), 256))
    left = keyed.join(dropped, keyed["doc_id"].eqNullSafe(dropped["__id"]) & (F.col("__digest") == F.col("__sum")),
                      "left_anti")
    row = F.struct(F.length("text").alias("__size"), *docs.columns)
    return left.groupBy("doc_id", "__digest").agg(F.max(row).alias("__row")).select(
        *[F.col("__row").getField(c).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group that links of similarity 0.8 on five words hold together."""
    found = near_duplicates(docs)
    dropped = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each span of personal data replaced by its kind; n_chars counts the new text."""
    masked = redact(find_pii(docs, base_col="__base", spans_col="__spans"), spans_col="__spans")
    if "n_chars" in docs.columns:
        changed = F.size("__spans") > 0
        masked = masked.withColumn("n_chars", F.when(changed, F.length("text").cast(
            docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return masked.select(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2048 tokens."""
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("PII", mask_personal_data),
    ("packing", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet in the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
