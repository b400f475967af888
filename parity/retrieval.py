"""Dense retrieval over `embeddings`: version_id = vec_id, clique_id = label."""

from __future__ import annotations

from pyspark.sql import functions as F

from parity.registry import query, table
from versionlake.functions.scorers import DenseScorer
from versionlake.operators import ids, ranking, tiles
from versionlake.session import reliable_checkpoint

SCORER = DenseScorer("embedding", "cosine")

# One CTE chain shared by the SQL side: unit vectors, scored pairs, full ranking.
DENSE = """
WITH v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT id, label, e, sqrt(list_inner_product(e, e)) AS n FROM v),
pairs AS (
  SELECT q.id AS query_id, c.id AS corpus_id, (q.label = c.label)::INT AS relevant,
         round(list_inner_product(q.e, c.e) / (q.n * c.n), 9) AS score
  FROM u q JOIN u c ON q.id <> c.id),
ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, corpus_id))::INT AS rank FROM pairs),
firsts AS (
  SELECT query_id, min(rank) AS rank, arg_min(corpus_id, rank) AS corpus_id, arg_min(score, rank) AS score
  FROM ranked WHERE relevant = 1 GROUP BY query_id),
truth AS (
  SELECT vec_id AS query_id, label AS clique_id, count(*) OVER (PARTITION BY label) - 1 AS n_relevant
  FROM embeddings QUALIFY count(*) OVER (PARTITION BY label) > 1)
"""


def recordings(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    meta = e.select(F.col("vec_id").alias("version_id"), F.col("label").alias("clique_id"))
    vectors = e.select(F.col("vec_id").alias("id"), "embedding")
    return meta, vectors


def dense_inputs(spark, sf_dir):
    meta, vectors = recordings(spark, sf_dir)
    return ranking.evaluation_set(meta, vectors)


def dense_parts(spark, sf_dir, k=100):
    queries, corpus = dense_inputs(spark, sf_dir)
    cells = tiles.grid_shape(queries, corpus, SCORER)
    ranked = reliable_checkpoint(ranking.rank_results(queries, corpus, SCORER, k, cells))
    first = ranking.first_relevant(queries, corpus, SCORER, ranked, cells)
    return queries, corpus, ranked, first


@query("ground_truth", """
SELECT vec_id AS query_id, label AS clique_id, (count(*) OVER (PARTITION BY label) - 1)::BIGINT AS n_relevant
FROM embeddings QUALIFY count(*) OVER (PARTITION BY label) > 1""")
def ground_truth(spark, sf_dir):
    meta, _ = recordings(spark, sf_dir)
    return ranking.ground_truth(meta)


@query("dense_topk", DENSE + """
SELECT query_id, corpus_id, round(score, 6) AS score, rank, relevant FROM ranked WHERE rank <= 10""")
def dense_topk(spark, sf_dir):
    queries, corpus = dense_inputs(spark, sf_dir)
    return ranking.rank_results(queries, corpus, SCORER, 10).withColumn("score", F.round("score", 6))


@query("first_relevant", DENSE + """
SELECT query_id, corpus_id, rank, round(score, 6) AS score FROM firsts""")
def first_relevant(spark, sf_dir):
    queries, corpus = dense_inputs(spark, sf_dir)
    return (ranking.first_relevant(queries, corpus, SCORER).withColumn("score", F.round("score", 6)))


@query("false_positives", DENSE + """
SELECT query_id, corpus_id, round(score, 6) AS score FROM ranked WHERE rank = 1 AND relevant = 0""")
def false_positives(spark, sf_dir):
    queries, corpus = dense_inputs(spark, sf_dir)
    ranked = ranking.rank_results(queries, corpus, SCORER, 1)
    return ranking.false_positives(ranked).select("query_id", "corpus_id", F.round("score", 6).alias("score"))


@query("error_table", DENSE + """
SELECT f.query_id, f.corpus_id AS fn_id, round(f.score, 6) AS fn_score, f.rank AS fn_rank,
       r.corpus_id AS fp_id, round(r.score, 6) AS fp_score, r.rank AS fp_rank
FROM firsts f LEFT JOIN (SELECT * FROM ranked WHERE rank = 1 AND relevant = 0) r USING (query_id)
WHERE f.rank <> 1""")
def error_table(spark, sf_dir):
    _, _, ranked, first = dense_parts(spark, sf_dir)
    out = ranking.error_table(first, ranking.false_positives(ranked))
    return out.withColumn("fn_score", F.round("fn_score", 6)).withColumn("fp_score", F.round("fp_score", 6))


@query("error_table_by_fp", DENSE + """
SELECT r.query_id, r.corpus_id AS fp_id, round(r.score, 6) AS fp_score, r.rank AS fp_rank,
       f.corpus_id AS tp_id, round(f.score, 6) AS tp_score, f.rank AS tp_rank
FROM ranked r LEFT JOIN firsts f USING (query_id) WHERE r.rank = 1 AND r.relevant = 0""")
def error_table_by_fp(spark, sf_dir):
    _, _, ranked, first = dense_parts(spark, sf_dir)
    out = ranking.error_table_by_false_positive(first, ranking.false_positives(ranked))
    return out.withColumn("fp_score", F.round("fp_score", 6)).withColumn("tp_score", F.round("tp_score", 6))


METRICS = """,
hits AS (
  SELECT *, sum(relevant) OVER (PARTITION BY query_id ORDER BY rank) AS hits FROM ranked WHERE rank <= 100),
per AS (
  SELECT t.query_id, t.n_relevant,
         coalesce(max(CASE WHEN rank = 1 THEN relevant ELSE 0 END), 0) AS h1,
         coalesce(max(CASE WHEN rank <= 10 THEN relevant ELSE 0 END), 0) AS h10,
         coalesce(max(relevant), 0) AS h100,
         coalesce(sum(CASE WHEN rank <= 10 AND relevant = 1 THEN hits / rank::DOUBLE ELSE 0 END), 0)
           / least(10, greatest(1, t.n_relevant)) AS ap
  FROM truth t LEFT JOIN hits h ON h.query_id = t.query_id GROUP BY t.query_id, t.n_relevant)
"""


@query("dense_metrics", DENSE + METRICS + """
SELECT round(avg(f.rank), 6) AS MR1, round(avg(h1), 6) AS HR1, round(avg(h10), 6) AS HR10,
       round(avg(h100), 6) AS HR100, round(avg(ap), 6) AS MAP10 FROM per LEFT JOIN firsts f USING (query_id)""")
def dense_metrics(spark, sf_dir):
    queries, _, ranked, first = dense_parts(spark, sf_dir)
    out = ranking.retrieval_metrics(ranked, first, queries.select(F.col("id").alias("query_id"), "n_relevant"))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("error_metrics", DENSE + """,
e AS (SELECT abs(r.rank - f.rank) AS rd, abs(r.score - f.score) AS sd
      FROM ranked r LEFT JOIN firsts f USING (query_id) WHERE r.rank = 1 AND r.relevant = 0)
SELECT (SELECT count(*) FROM ranked WHERE rank = 1 AND relevant = 1)::BIGINT AS nb_tp,
       (SELECT count(*) FROM truth)::BIGINT
         - (SELECT count(*) FROM ranked WHERE rank = 1 AND relevant = 1)::BIGINT AS nb_fp,
       round(avg(rd), 6) AS mean_rank_diff, round(avg(sd), 6) AS mean_score_diff FROM e""")
def error_metrics(spark, sf_dir):
    queries, _, ranked, first = dense_parts(spark, sf_dir)
    errors = ranking.error_table_by_false_positive(first, ranking.false_positives(ranked))
    out = ranking.error_metrics(ranked, errors, queries.select(F.col("id").alias("query_id")))
    return out.select("nb_tp", "nb_fp", F.round("mean_rank_diff", 6).alias("mean_rank_diff"),
                      F.round("mean_score_diff", 6).alias("mean_score_diff"))


@query("full_ap_r1_rpc", DENSE + """,
d AS (SELECT q.id AS query_id, c.id AS corpus_id, (q.label = c.label)::INT AS rel,
             round(list_inner_product(q.e, c.e) / ((q.n + 1e-6) * (c.n + 1e-6)), 9) AS sim
      FROM u q JOIN u c ON q.id <> c.id),
o AS (SELECT query_id, rel, row_number() OVER w AS rn, sum(rel) OVER w AS hits, sum(1 - rel) OVER w AS misses
      FROM d WINDOW w AS (PARTITION BY query_id ORDER BY sim DESC, corpus_id ROWS UNBOUNDED PRECEDING)),
n AS (SELECT query_id, sum(1 - rel) + 1 AS nonmatch FROM d GROUP BY query_id)
SELECT query_id, round(avg(hits / rn::DOUBLE), 6) AS ap, min(rn) AS r1,
       round(100 * avg(misses / nonmatch::DOUBLE), 6) AS rpc, count(*) AS n_relevant
FROM o JOIN n USING (query_id) WHERE rel = 1 GROUP BY query_id""")
def full_ap_r1_rpc(spark, sf_dir):
    queries, corpus = dense_inputs(spark, sf_dir)
    out = ranking.full_ranking_metrics(queries, corpus, DenseScorer("embedding", "cos"))
    return out.select("query_id", F.round("ap", 6).alias("ap"), "r1", F.round("rpc", 6).alias("rpc"), "n_relevant")


@query("full_ap_r1_rpc_excluded", DENSE + """,
d AS (SELECT q.id AS query_id, c.id AS corpus_id, (q.label = c.label)::INT AS rel,
             round(list_inner_product(q.e, c.e) / ((q.n + 1e-6) * (c.n + 1e-6)), 9) AS sim
      FROM u q JOIN u c ON q.id <> c.id WHERE q.id // 5 <> c.id // 5),
o AS (SELECT query_id, rel, row_number() OVER w AS rn, sum(rel) OVER w AS hits, sum(1 - rel) OVER w AS misses
      FROM d WINDOW w AS (PARTITION BY query_id ORDER BY sim DESC, corpus_id ROWS UNBOUNDED PRECEDING)),
n AS (SELECT query_id, sum(1 - rel) + 1 AS nonmatch FROM d GROUP BY query_id)
SELECT query_id, round(avg(hits / rn::DOUBLE), 6) AS ap, min(rn) AS r1,
       round(100 * avg(misses / nonmatch::DOUBLE), 6) AS rpc, count(*) AS n_relevant
FROM o JOIN n USING (query_id) WHERE rel = 1 GROUP BY query_id""")
def full_ap_r1_rpc_excluded(spark, sf_dir):
    """Full-ranking metrics without pairs of one performance, in small cells and parts, as for cliques beyond a cell."""
    queries, corpus = dense_inputs(spark, sf_dir)
    places = corpus.select(F.floor(F.col("id") / 5).alias("perf"), F.col("id").alias("position"))
    same = ids.overlap_map(places, places).select(
        F.col("query_pos").alias("query_id"), F.col("ref_pos").alias("corpus_id"))
    out = ranking.full_ranking_metrics(queries, corpus, DenseScorer("embedding", "cos"), bar_rows=16, exclude=same, cell_rows=32)
    return out.select("query_id", F.round("ap", 6).alias("ap"), "r1", F.round("rpc", 6).alias("rpc"), "n_relevant")


@query("map_matrix", DENSE + """,
h AS (SELECT *, sum(relevant) OVER (PARTITION BY query_id ORDER BY rank) AS hits FROM ranked),
p AS (SELECT query_id, sum(CASE WHEN rank <= 10 AND relevant = 1 THEN hits / rank::DOUBLE END)
             / nullif(sum(CASE WHEN rank <= 10 THEN relevant END), 0) AS ap,
             sum(CASE WHEN rank <= 10 THEN relevant ELSE 0 END) AS t10,
             max(CASE WHEN rank = 1 THEN relevant ELSE 0 END) AS hit
      FROM h GROUP BY query_id)
SELECT round(avg(coalesce(ap, 0)), 6) AS mean_ap, round(avg(t10) / 10, 6) AS top10,
       round(avg(coalesce(f.rank, 0)), 6) AS rank1, round(avg(hit), 6) AS hit_rate
FROM p LEFT JOIN firsts f USING (query_id)""")
def map_matrix(spark, sf_dir):
    queries, _, ranked, first = dense_parts(spark, sf_dir, k=10)
    out = ranking.matrix_metrics(ranked, first, queries.select(F.col("id").alias("query_id")))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("map_matrix_excluded", DENSE + """,
kept AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, corpus_id) AS place FROM pairs
         WHERE query_id // 5 <> corpus_id // 5),
near AS (SELECT query_id, min(place) AS first_at FROM kept WHERE relevant = 1 GROUP BY query_id),
h AS (SELECT query_id, place, relevant, sum(relevant) OVER (PARTITION BY query_id ORDER BY place) AS hits FROM kept),
p AS (SELECT query_id, sum(CASE WHEN place <= 10 AND relevant = 1 THEN hits / place::DOUBLE END)
             / nullif(sum(CASE WHEN place <= 10 THEN relevant END), 0) AS ap,
             sum(CASE WHEN place <= 10 THEN relevant ELSE 0 END) AS t10,
             max(CASE WHEN place = 1 THEN relevant ELSE 0 END) AS hit
      FROM h GROUP BY query_id)
SELECT round(avg(coalesce(ap, 0)), 6) AS mean_ap, round(avg(t10) / 10, 6) AS top10,
       round(avg(coalesce(first_at, 0)), 6) AS rank1, round(avg(hit), 6) AS hit_rate
FROM p LEFT JOIN near USING (query_id)""")
def map_matrix_excluded(spark, sf_dir):
    """Matrix metrics without pairs of one performance; five neighbouring vectors are one performance."""
    queries, corpus = dense_inputs(spark, sf_dir)
    places = corpus.select(F.floor(F.col("id") / 5).alias("perf"), F.col("id").alias("position"))
    same = ids.overlap_map(places, places).select(
        F.col("query_pos").alias("query_id"), F.col("ref_pos").alias("corpus_id"))
    ranked = reliable_checkpoint(ranking.rank_results(queries, corpus, SCORER, 10, exclude=same))
    first = ranking.first_relevant(queries, corpus, SCORER, ranked, exclude=same)
    out = ranking.matrix_metrics(ranked, first, queries.select(F.col("id").alias("query_id")))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("nearest_n", DENSE + """
SELECT query_id, corpus_id, round(1 - score, 6) AS dist FROM pairs
WHERE query_id = (SELECT min(vec_id) FROM embeddings) ORDER BY 1 - score, corpus_id LIMIT 10""")
def nearest_n(spark, sf_dir):
    _, corpus = dense_inputs(spark, sf_dir)
    probe = corpus.where(F.col("id") == F.lit(corpus.agg(F.min("id")).first()[0]))
    found = tiles.top_k(probe, corpus, DenseScorer("embedding", "cosine"), 10)
    return ranking.nearest(found.withColumn("score", 1 - F.col("score")), 10)
