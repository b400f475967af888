"""Re-ranking of candidate lists with a pair scorer."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from versionlake.operators.ids import require_columns
from versionlake.operators.ranking import restrict_to, retrieval_metrics

# Records whose texts, with the pairs they are in, go to one partition.
PART_TEXTS = 4096


def filter_candidates(ranked: DataFrame, corpus: DataFrame | None = None, corpus_column: str = "id") -> DataFrame:
    """Candidates inside the corpus, of queries with a relevant candidate, be that one inside the corpus or not."""
    require_columns(ranked, ["query_id", "corpus_id", "rank", "relevant"])
    useful = ranked.where("relevant = 1").select("query_id").distinct()
    kept = ranked.join(useful, "query_id", "left_semi")
    return restrict_to(kept, corpus, "corpus_id", corpus_column) if corpus is not None else kept


def rerank(ranked: DataFrame, texts: DataFrame, scorer: Callable[[Column, Column], Column],
           id_col: str = "version_id", text_col: str = "text") -> DataFrame:
    """New score and rank of every candidate; ties keep the old order. A missing text counts as empty.
    The text column may also hold token arrays, if that is what the scorer takes."""
    def side(name: str, column: str) -> DataFrame:
        return texts.select(F.col(id_col).alias(column), F.col(text_col).alias(name))

    # texts repeat with the pairs, so partitions grow with the records; queries come last, as they have no hot key
    session = ranked.sparkSession
    parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), math.ceil(texts.count() / PART_TEXTS))
    pairs = ranked.select("query_id", "corpus_id", F.col("rank").alias("old_rank"), "relevant")
    for name, column in (("_d", "corpus_id"), ("_q", "query_id")):
        pairs = pairs.repartition(parts, column).join(side(name, column).repartition(parts, column), column, "left")
    kind = texts.schema[text_col].dataType
    empty = F.array().cast(kind) if kind.typeName() == "array" else F.lit("")
    scored = pairs.withColumn("score", F.round(scorer(F.coalesce("_q", empty), F.coalesce("_d", empty)), 9))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "old_rank"))
    return scored.select("query_id", "corpus_id", "score", "relevant", "old_rank").withColumn("rank", place).select(
        "query_id", "corpus_id", "score", "rank", "relevant", "old_rank")


def first_relevant_in_list(ranked: DataFrame) -> DataFrame:
    """Best-ranked relevant candidate of every query within its list."""
    return (ranked.where("relevant = 1").groupBy("query_id")
            .agg(F.min(F.struct("rank", "corpus_id", "score")).alias("f"))
            .select("query_id", "f.corpus_id", "f.rank", "f.score"))


def rerank_metrics(reranked: DataFrame, queries: DataFrame) -> DataFrame:
    """Metrics over the re-ranked lists; `queries` (query_id, n_relevant) is cut to the queries that remain."""
    remaining = restrict_to(queries, reranked, "query_id", "query_id")
    return retrieval_metrics(reranked, first_relevant_in_list(reranked), remaining)
