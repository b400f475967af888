"""Ground truth, ranked lists, error tables and retrieval metrics.

Ground truth is kept as labels: record c is relevant for query q when both have the same clique and are
different records. The list of all positive pairs is never written; its size would be quadratic in a clique.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from versionlake.functions.scorers import MaxScorer, SoftmaxMeanScorer
from versionlake.operators import tiles
from versionlake.session import reliable_checkpoint

BAR_ROWS = 4096


# ---------------------------------------------------------------- ground truth

def ground_truth(recordings: DataFrame, id_col: str = "version_id", clique_col: str = "clique_id") -> DataFrame:
    """Queries (recordings with at least one other version): query_id, clique_id, n_relevant."""
    sizes = (recordings.where(F.col(clique_col).isNotNull()).groupBy(clique_col)
             .agg(F.count("*").alias("_n")).where("_n >= 2"))
    return (recordings.join(sizes, clique_col)
            .select(F.col(id_col).alias("query_id"), F.col(clique_col).alias("clique_id"),
                    (F.col("_n") - 1).alias("n_relevant")))


def restrict_to(df: DataFrame, valid: DataFrame, column: str = "id", valid_column: str = "id") -> DataFrame:
    """Keep rows whose id occurs in `valid` (semi join)."""
    return df.join(valid.select(F.col(valid_column).alias(column)).distinct(), column, "left_semi")


def evaluation_set(recordings: DataFrame, embeddings: DataFrame, id_col: str = "version_id",
                   clique_col: str = "clique_id", embedding_id: str = "id",
                   query_embeddings: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(queries, corpus) for the ranking operators, both restricted to recordings with embeddings.

    A query is any recording with another version in `recordings`; `n_relevant` counts the versions that
    are left after the restriction and may be 0. Queries may use vectors of their own.
    """
    labelled = recordings.select(F.col(id_col).alias("id"), F.col(clique_col).alias("label"))
    corpus = labelled.join(embeddings.withColumnRenamed(embedding_id, "id"), "id")
    reachable = (restrict_to(labelled, embeddings, "id", embedding_id).groupBy("label")
                 .agg((F.count("*") - 1).alias("n_relevant")))
    source = query_embeddings if query_embeddings is not None else embeddings
    queries = (ground_truth(recordings, id_col, clique_col)
               .select(F.col("query_id").alias("id"), F.col("clique_id").alias("label")))
    queries = restrict_to(queries, embeddings, "id", embedding_id)
    queries = (queries.join(source.withColumnRenamed(embedding_id, "id"), "id")
               .join(reachable, "label"))
    return queries, corpus


def with_relevance(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """Set `relevant` from an explicit pair table (query_id, corpus_id) instead of labels."""
    marks = truth.select("query_id", "corpus_id").distinct().withColumn("_hit", F.lit(1))
    return (ranked.drop("relevant").join(marks, ["query_id", "corpus_id"], "left")
            .withColumn("relevant", F.coalesce(F.col("_hit"), F.lit(0))).drop("_hit"))


# ---------------------------------------------------------------- ranked lists

def rank_results(queries: DataFrame, corpus: DataFrame, scorer, k: int = 100, cells=None,
                 exclude: DataFrame | None = None) -> DataFrame:
    """Top k of every query under any scorer; see `tiles.top_k`. Excluded pairs still count in the softmax sums."""
    if isinstance(scorer, SoftmaxMeanScorer):
        cells = cells or tiles.grid_shape(queries, corpus, scorer)
        stats = tiles.softmax_stats(queries, corpus, scorer, cells)
        queries = queries.join(stats.withColumnRenamed("query_id", "id"), "id")
    return tiles.top_k(queries, corpus, scorer, k, cells, exclude=exclude)


def fusion_scorer(a, b, method: str = "mean"):
    """Fuse two scorers: `mean` of row-wise softmaxes or `max` of raw scores."""
    if method == "mean":
        return SoftmaxMeanScorer(parts=[a, b])
    if method == "max":
        return MaxScorer(parts=[a, b])
    raise ValueError(f"unknown fusion method: {method}")


def first_relevant(queries: DataFrame, corpus: DataFrame, scorer, ranked: DataFrame | None = None,
                   cells=None, exclude: DataFrame | None = None) -> DataFrame:
    """Best-ranked relevant record on the full ranking: query_id, corpus_id, rank, score.
    The pairs of `exclude` (query_id, corpus_id) take no place; a given ranked list must leave them out too.

    No full sort: the best positive comes from cells of whole labels, its rank is one more than the number
    of records scored before it. With a ranked list at hand (stored or checkpointed: it is read twice) only
    queries without a hit in it are counted.
    """
    if ranked is not None:
        near = (ranked.where("relevant = 1").groupBy("query_id")
                .agg(F.min(F.struct("rank", "corpus_id", "score")).alias("f"))
                .select("query_id", "f.corpus_id", "f.rank", "f.score"))
        near = reliable_checkpoint(near)
        rest = reliable_checkpoint(queries.join(near.select(F.col("query_id").alias("id")), "id", "left_anti"))
        if rest.limit(1).isEmpty():
            return near
        # a grid of their own: they are few, so the corpus need not be copied for them
        return near.unionByName(first_relevant(rest, corpus, scorer, None, None, exclude))
    cells = cells or tiles.grid_shape(queries, corpus, scorer)
    # records of works that nobody asks for can't be the best
    asked = queries.select("label").distinct()
    best = reliable_checkpoint(tiles.best_positive(queries, corpus.join(asked, "label", "left_semi"), scorer, exclude=exclude))
    bars = best.select("query_id", F.lit(0).alias("part"), F.array("score").alias("bar_scores"),
                       F.array("corpus_id").alias("bar_ids"))
    ahead = tiles.count_ahead(queries, corpus, scorer, bars, cells, exclude).select("query_id", "n_ahead")
    return (best.join(ahead, "query_id")
            .select("query_id", "corpus_id", (F.col("n_ahead") + 1).cast("int").alias("rank"), "score"))


def false_positives(ranked: DataFrame) -> DataFrame:
    """Wrong results at rank 1."""
    return ranked.where("rank = 1 and relevant = 0")


def error_table(first: DataFrame, false_pos: DataFrame) -> DataFrame:
    """One row a query whose first relevant record is not at rank 1, with the false positive beside it."""
    wrong = false_pos.select("query_id", F.col("corpus_id").alias("fp_id"), F.col("score").alias("fp_score"),
                             F.col("rank").alias("fp_rank"))
    return (first.where("rank <> 1")
            .select("query_id", F.col("corpus_id").alias("fn_id"), F.col("score").alias("fn_score"),
                    F.col("rank").alias("fn_rank"))
            .join(wrong, "query_id", "left"))


def error_table_by_false_positive(first: DataFrame, false_pos: DataFrame) -> DataFrame:
    """Earlier form: keyed on the false positive; the true positive may be missing."""
    true_pos = first.select("query_id", F.col("corpus_id").alias("tp_id"), F.col("score").alias("tp_score"),
                            F.col("rank").alias("tp_rank"))
    return (false_pos.select("query_id", F.col("corpus_id").alias("fp_id"),
                             F.col("score").alias("fp_score"), F.col("rank").alias("fp_rank"))
            .join(true_pos, "query_id", "left"))


# ---------------------------------------------------------------- metrics

def per_query_hits(ranked: DataFrame) -> DataFrame:
    """query_id, hit1, hit10, hit100, precision_sum (over relevant ranks up to 10)."""
    upto = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    rank, rel = F.col("rank"), F.col("relevant")
    return (ranked.withColumn("hits", F.sum("relevant").over(upto)).groupBy("query_id").agg(
        F.max(F.when(rank == 1, rel).otherwise(0)).alias("hit1"),
        F.max(F.when(rank <= 10, rel).otherwise(0)).alias("hit10"),
        F.max(F.when(rank <= 100, rel).otherwise(0)).alias("hit100"),
        F.sum(F.when((rank <= 10) & (rel == 1), F.col("hits") / rank).otherwise(0.0)).alias("precision_sum")))


def retrieval_metrics(ranked: DataFrame, first: DataFrame, queries: DataFrame) -> DataFrame:
    """One row MR1, HR1, HR10, HR100, MAP10. `queries`: query_id, n_relevant; all of them count in the means,
    except that MR1 averages only queries with a reachable relevant record (0.0 when there is none)."""
    divisor = F.least(F.lit(10), F.greatest(F.lit(1), F.col("n_relevant")))
    joined = (queries.select("query_id", "n_relevant").join(per_query_hits(ranked), "query_id", "left")
              .join(first.select("query_id", F.col("rank").alias("first_rank")), "query_id", "left"))

    def mean(expr):
        return F.coalesce(F.avg(F.coalesce(expr, F.lit(0.0))), F.lit(0.0))

    return joined.agg(
        F.coalesce(F.avg("first_rank"), F.lit(0.0)).alias("MR1"),
        mean(F.col("hit1").cast("double")).alias("HR1"), mean(F.col("hit10").cast("double")).alias("HR10"),
        mean(F.col("hit100").cast("double")).alias("HR100"),
        mean(F.col("precision_sum") / divisor).alias("MAP10"))


def error_metrics(ranked: DataFrame, errors_by_fp: DataFrame, queries: DataFrame) -> DataFrame:
    """nb_tp, nb_fp, mean_rank_diff, mean_score_diff; missing true positives are ignored in the means."""
    top = ranked.where("rank = 1 and relevant = 1").select("query_id", F.lit(1).alias("tp"))
    diffs = errors_by_fp.select("query_id", F.abs(F.col("fp_rank") - F.col("tp_rank")).alias("rank_diff"),
                                F.abs(F.col("fp_score") - F.col("tp_score")).alias("score_diff"))
    return (queries.select("query_id").join(top, "query_id", "left").join(diffs, "query_id", "left")
            .agg(F.count("tp").alias("nb_tp"), (F.count("*") - F.count("tp")).alias("nb_fp"),
                 F.avg("rank_diff").alias("mean_rank_diff"), F.avg("score_diff").alias("mean_score_diff")))


def full_ranking_metrics(queries: DataFrame, corpus: DataFrame, scorer, biased: bool = False,
                         bar_rows: int = BAR_ROWS, cells=None, exclude: DataFrame | None = None,
                         cell_rows: int = tiles.CELL_ROWS, held_scores: int = tiles.HELD_SCORES) -> DataFrame:
    """Per query over the whole ranking: ap, r1 (rank of the first correct record), rpc (rank percentile).

    The pairs of `exclude` (query_id, corpus_id) take no place in it. The query stays among the candidates as a non-match
    behind all others. The positives of a query, which all queries together have as many of as the squared sizes of cliques,
    are placed inside the task that scored them and never written. Only for a corpus of more than `held_scores` records,
    whose scores with one query a task can't hold, they leave the cells as sorted runs, are merged into parts of at most
    twice `bar_rows`, and a tile pass counts the candidates before each entry of a part.
    """
    usable = tiles.usable(corpus, scorer)
    total = usable.count()
    if total <= held_scores:
        sums = tiles.placed_positives(queries, corpus, scorer, cells, exclude, cell_rows, held_scores)
    else:
        sums = _placed_in_parts(queries, corpus, scorer, bar_rows, cells, exclude, cell_rows)
    candidates = F.lit(total)
    if exclude is not None:
        gone = (exclude.select("query_id", "corpus_id").distinct().where("query_id <> corpus_id")
                .join(usable.select(F.col("id").alias("corpus_id")), "corpus_id", "left_semi")
                .groupBy("query_id").agg(F.count("*").alias("gone")))
        sums = sums.join(gone, "query_id", "left")
        candidates = F.lit(total) - F.coalesce("gone", F.lit(0))
    n = F.col("n_relevant")
    if biased:
        percentile = F.col("all_ahead") / (candidates - 1).cast("double") / n
    else:
        # of those ahead of the i-th positive, i - 1 are positives themselves
        percentile = (F.col("all_ahead") - n * (n - 1) / 2) / (candidates - n) / n
    return sums.select("query_id", (F.col("precision") / n).alias("ap"), "r1", (100 * percentile).alias("rpc"), "n_relevant")


def _placed_in_parts(queries: DataFrame, corpus: DataFrame, scorer, bar_rows: int, cells, exclude: DataFrame | None,
                     cell_rows: int) -> DataFrame:
    """`tiles.placed_positives` by way of written runs and parts: memory is bounded whatever the corpus, disk is not."""
    # sized by the plain queries: counting the rows with bars would run the positives pass twice
    cells = cells or tiles.grid_shape(queries, corpus, scorer)
    runs = reliable_checkpoint(tiles.positive_runs(queries, corpus, scorer, None, cell_rows, exclude))
    parts = reliable_checkpoint(tiles.ranked_parts(runs, bar_rows))
    bars = parts.select("query_id", "part", F.col("scores").alias("bar_scores"), F.col("corpus_ids").alias("bar_ids"))
    ahead = tiles.ahead_arrays(queries, corpus, scorer, bars, cells, exclude)
    ahead = ahead.join(parts.select("query_id", "part", "before"), ["query_id", "part"])
    precision = F.zip_with("ahead", F.sequence(F.lit(1), F.size("ahead")),
                           lambda n, i: (F.col("before") + i) / (n + 1))
    return ahead.groupBy("query_id").agg(
        F.sum(F.aggregate(precision, F.lit(0.0), lambda a, x: a + x)).alias("precision"),
        (F.min(F.array_min("ahead")) + 1).alias("r1"), F.sum(F.size("ahead")).alias("n_relevant"),
        F.sum(F.aggregate("ahead", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("all_ahead"))


def matrix_metrics(ranked: DataFrame, first: DataFrame, queries: DataFrame, topk: int = 10) -> DataFrame:
    """mean_ap (over the hits found in the first `topk`), top10, rank1 (0 without a match), hit_rate.

    `ranked` must reach rank max(topk, 10); pairs to leave out are simply absent from it.
    """
    upto = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    inside = (F.col("rank") <= topk) & (F.col("relevant") == 1)
    per = (ranked.withColumn("hits", F.sum("relevant").over(upto)).groupBy("query_id").agg(
        F.sum(F.when(inside, F.col("hits") / F.col("rank"))).alias("precision_sum"),
        F.sum(F.when(inside, 1)).alias("found"),
        F.sum(F.when(inside & (F.col("rank") <= 10), 1)).alias("in10"),
        F.max(F.when(F.col("rank") == 1, F.col("relevant"))).alias("hit")))
    joined = (queries.select("query_id").join(per, "query_id", "left")
              .join(first.select("query_id", F.col("rank").alias("first_rank")), "query_id", "left"))

    def mean(expr):
        return F.avg(F.coalesce(expr.cast("double"), F.lit(0.0)))

    return joined.agg(mean(F.col("precision_sum") / F.col("found")).alias("mean_ap"),
                      (mean(F.col("in10")) / 10).alias("top10"), mean(F.col("first_rank")).alias("rank1"),
                      mean(F.col("hit")).alias("hit_rate"))


def nearest(ranked: DataFrame, n: int, digits: int = 6) -> DataFrame:
    """The n nearest records to one query, given its distances (score column), rounded."""
    return (ranked.orderBy("score", "corpus_id").limit(n)
            .select("query_id", "corpus_id", F.round("score", digits).alias("dist")))
