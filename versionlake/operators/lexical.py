"""Lexical vectors: TF-IDF and BM25, as one row of parallel arrays (terms, weights) a document.

Ranking goes through the tiles with a `SparseScorer`, so a term that occurs in a third of all documents
does not produce a third-of-all-documents squared join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from versionlake.functions import text as X
from versionlake.operators import tiles
from versionlake.session import reliable_checkpoint, spread_small

# Saturation and length weights of the BM25 variant; share of documents that makes a term hot,
# and the largest vocabulary that is broadcast.
BM25_K1 = 1.5
BM25_B = 0.75
HOT_SHARE = 0.01
BROADCAST_TERMS = 500_000
# Pairs of vectors whose terms a worker compares at a time.
PAIRS = 256


def counted(docs: DataFrame, id_col: str = "id", text_col: str = "text",
            stop_words: list[str] | None = None) -> DataFrame:
    """id, terms, counts, n_tokens: the distinct tokens of each document with their number."""
    kind = docs.schema[id_col].dataType.simpleString()
    texts = spread_small(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id")
    return texts.mapInArrow(X.term_counter(stop_words),
                            f"id {kind}, terms array<string>, counts array<long>, n_tokens long")


def _counted_once(docs: DataFrame, id_col: str, text_col: str, stop_words: list[str] | None) -> DataFrame:
    return tiles.compact_checkpoint(counted(docs, id_col, text_col, stop_words), ("terms",))


def term_counts(docs: DataFrame, id_col: str = "id", text_col: str = "text",
                stop_words: list[str] | None = None) -> DataFrame:
    """Exploded form: id, term, tf."""
    return _exploded(counted(docs, id_col, text_col, stop_words))


def _exploded(rows: DataFrame) -> DataFrame:
    return (rows.select("id", F.explode(F.arrays_zip("terms", "counts")).alias("p"))
            .select("id", F.col("p.terms").alias("term"), F.col("p.counts").alias("tf")))


def _term_stats(rows: DataFrame) -> tuple[DataFrame, int]:
    """(term, df, total) and the number of terms. Written once: every later step reads it."""
    stats = reliable_checkpoint(_exploded(rows).groupBy("term").agg(
        F.count("*").alias("df"), F.sum("tf").alias("total")))
    return stats, stats.count()


def _attach(counts: DataFrame, stats: DataFrame, n_terms: int, n_docs: int) -> DataFrame:
    """Join term statistics to term counts.

    A vocabulary of at most BROADCAST_TERMS is broadcast. Beyond that, only terms in more than HOT_SHARE of
    the documents are (there are at most (distinct terms of a mean document) / HOT_SHARE of them), and the
    join of the rest has no hot key.
    """
    if n_terms <= BROADCAST_TERMS:
        return counts.join(F.broadcast(stats), "term")
    is_hot = F.col("df") > n_docs * HOT_SHARE
    hot, cold = F.broadcast(stats.where(is_hot)), stats.where(~is_hot)
    return counts.join(hot, "term").unionByName(
        counts.join(F.broadcast(stats.where(is_hot).select("term")), "term", "left_anti").join(cold, "term"))


def _vectors(weighted: DataFrame, docs: DataFrame, unit: bool) -> DataFrame:
    # the norm is an aggregate of its own: inside the lambda it would be computed again for every term
    scale = F.sqrt(F.sum(F.col("weight") * F.col("weight"))) if unit else F.lit(1.0)
    # dealt by document first: lists begun before the shuffle would be sorted there and again behind it
    rows = weighted.repartition("id").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("v"),
                                      scale.alias("scale"))
    rows = rows.select("id", F.transform("v", lambda x: x["term"]).alias("terms"),
                       F.transform("v", lambda x: x["weight"] / F.col("scale")).alias("weights"))
    return (docs.select("id").join(rows, "id", "left")
            .withColumns({"terms": F.coalesce("terms", F.array().cast("array<string>")),
                          "weights": F.coalesce("weights", F.array().cast("array<double>"))}))


@dataclass
class TfidfModel:
    """Fitted vocabulary (term, df, idf) with its size and the number of documents.

    `fitted` has the documents of the fit, how they were read and their counted terms, so that they are tokenised once.
    """

    stats: DataFrame
    n_terms: int
    n_docs: int
    fitted: tuple[DataFrame, tuple, DataFrame] | None = None


def tfidf_fit(docs: DataFrame, id_col: str = "id", text_col: str = "text", max_features: int | None = None,
              stop_words: list[str] | None = None) -> TfidfModel:
    """idf = ln((1 + n) / (1 + df)) + 1. `max_features` keeps the terms of the highest total count."""
    rows = _counted_once(docs, id_col, text_col, stop_words)
    return replace(_fit(rows, max_features), fitted=(docs, (id_col, text_col, tuple(stop_words or ())), rows))


def tfidf_transform(docs: DataFrame, model: TfidfModel, id_col: str = "id", text_col: str = "text",
                    stop_words: list[str] | None = None) -> DataFrame:
    """Unit TF-IDF vectors under a fitted model: id, terms, weights; unknown terms are dropped."""
    fitted = model.fitted
    if fitted is not None and fitted[0] is docs and fitted[1] == (id_col, text_col, tuple(stop_words or ())):
        return _transform(fitted[2], model)
    return _transform(_counted_once(docs, id_col, text_col, stop_words), model)


def tfidf(docs: DataFrame, id_col: str = "id", text_col: str = "text", max_features: int | None = None,
          stop_words: list[str] | None = None) -> DataFrame:
    """Fit and transform the same documents; they are tokenised once."""
    rows = _counted_once(docs, id_col, text_col, stop_words)
    return _transform(rows, _fit(rows, max_features))


def _fit(rows: DataFrame, max_features: int | None) -> TfidfModel:
    n = rows.count()
    stats, n_terms = _term_stats(rows)
    if max_features is not None:
        stats, n_terms = stats.orderBy(F.col("total").desc(), "term").limit(max_features), min(n_terms, max_features)
    idf = F.log((1.0 + n) / (1.0 + F.col("df"))) + 1.0
    return TfidfModel(stats.select("term", "df", idf.alias("idf")), n_terms, n)


def _transform(rows: DataFrame, model: TfidfModel) -> DataFrame:
    weighted = (_attach(_exploded(rows), model.stats, model.n_terms, model.n_docs)
                .select("id", "term", (F.col("tf") * F.col("idf")).alias("weight")))
    return _vectors(weighted, rows, unit=True)


def bm25_index(docs: DataFrame, id_col: str = "id", text_col: str = "text", k1: float = BM25_K1,
               b: float = BM25_B, stop_words: list[str] | None = None) -> DataFrame:
    """Corpus side of BM25: id, terms, weights."""
    rows = _counted_once(docs, id_col, text_col, stop_words)
    n, mean = rows.agg(F.count("*"), F.avg("n_tokens")).first()
    stats, n_terms = _term_stats(rows)
    weighted = _bm25_weights(rows, stats, n_terms, n, mean, k1, b).select("id", "term", "weight")
    return _vectors(weighted, rows, unit=False)


def bm25_vectors(docs: DataFrame, id_col: str = "id", text_col: str = "text", k1: float = BM25_K1, b: float = BM25_B,
                 stop_words: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(queries, corpus) of BM25 among the same documents: id, terms, weights. Texts are tokenised and joined with the
    vocabulary once for both sides, and terms are their numbers in it, which are cheaper to move and compare than words."""
    rows = _counted_once(docs, id_col, text_col, stop_words)
    n, mean = rows.agg(F.count("*"), F.avg("n_tokens")).first()
    stats, n_terms = _term_stats(rows)
    weighted = _bm25_weights(rows, stats.withColumn("code", F.monotonically_increasing_id()), n_terms, n, mean, k1, b)
    lists = weighted.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("code", "weight", "tf"))).alias("v"))
    both = tiles.compact_checkpoint(rows.select("id").join(lists, "id", "left").select(
        "id", F.coalesce(F.col("v")["code"], F.array().cast("array<bigint>")).alias("terms"),
        F.coalesce(F.col("v")["weight"], F.array().cast("array<double>")).alias("weights"),
        F.coalesce(F.col("v")["tf"].cast("array<double>"), F.array().cast("array<double>")).alias("counts")), ("terms",))
    return both.select("id", "terms", F.col("counts").alias("weights")), both.select("id", "terms", "weights")


def _bm25_weights(rows: DataFrame, stats: DataFrame, n_terms: int, n_docs: int, mean: float | None, k1: float,
                  b: float) -> DataFrame:
    idf = F.log(1.0 + (F.lit(float(n_docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf, norm = F.col("tf"), F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("n_tokens") / F.lit(float(mean or 1.0)))
    long = (rows.select("id", "n_tokens", F.explode(F.arrays_zip("terms", "counts")).alias("p"))
            .select("id", "n_tokens", F.col("p.terms").alias("term"), F.col("p.counts").alias("tf")))
    return _attach(long, stats, n_terms, n_docs).withColumn("weight", idf * tf / (tf + norm))


def query_counts(docs: DataFrame, id_col: str = "id", text_col: str = "text",
                 stop_words: list[str] | None = None) -> DataFrame:
    """Query side of BM25: id, terms, weights (how often the query says each term)."""
    rows = counted(docs, id_col, text_col, stop_words)
    return rows.select("id", "terms", F.col("counts").cast("array<double>").alias("weights"))


def postings(vectors: DataFrame) -> DataFrame:
    """Exploded form: id, term, weight."""
    return (vectors.select("id", F.explode(F.arrays_zip("terms", "weights")).alias("p"))
            .select("id", F.col("p.terms").alias("term"), F.col("p.weights").alias("weight")))


def pair_cosine(pairs: DataFrame, vectors: DataFrame, out: str = "score") -> DataFrame:
    """Sum of products over shared terms for given pairs (query_id, corpus_id); pairs without any are absent.

    Vectors travel as one row a pair and side; their terms meet inside the task.
    """
    def side(name: str) -> DataFrame:
        return vectors.select(F.col("id").alias(f"{name}_id"), F.col("terms").alias(f"{name}_t"),
                              F.col("weights").alias(f"{name}_w"))

    both = pairs.select("query_id", "corpus_id").join(side("query"), "query_id").join(side("corpus"), "corpus_id")
    rated = both.select("query_id", "corpus_id", shared_product("query_t", "query_w", "corpus_t", "corpus_w").alias(out))
    return rated.where(F.col(out).isNotNull()).groupBy("query_id", "corpus_id").agg(F.sum(out).alias(out))


@F.arrow_udf(T.DoubleType())
def shared_product(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Sum of the products of weights at equal terms, null where two vectors share no term."""
    for batch in batches:
        out = [_shared_products(*(column[at:at + PAIRS] for column in batch)) for at in range(0, len(batch[0]), PAIRS)]
        yield pa.concat_arrays(out) if out else pa.array([], pa.float64())


def _shared_products(q_terms: pa.Array, q_weights: pa.Array, c_terms: pa.Array, c_weights: pa.Array) -> pa.Array:
    n = len(q_terms)
    terms = pa.concat_arrays([q_terms.flatten(), c_terms.flatten()]).dictionary_encode()
    code = terms.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    rows = [np.repeat(np.arange(n), pc.list_value_length(t).fill_null(0).to_numpy(zero_copy_only=False)) for t in (q_terms, c_terms)]
    cut, width = len(rows[0]), len(terms.dictionary) + 1
    sums = []
    for row, part, weights in zip(rows, (code[:cut], code[cut:]), (q_weights, c_weights)):
        key, number = np.unique((row * width + part)[part >= 0], return_inverse=True)
        values = weights.flatten().to_numpy(zero_copy_only=False).astype(np.float64)[part >= 0]
        # a term that a vector has several times counts with each of its weights
        sums.append((key, np.bincount(number, values, minlength=len(key))))
    shared, left, right = np.intersect1d(sums[0][0], sums[1][0], assume_unique=True, return_indices=True)
    row = shared // width
    total = np.bincount(row, sums[0][1][left] * sums[1][1][right], minlength=n)
    return pa.array(total, pa.float64(), mask=np.bincount(row, minlength=n) == 0)
