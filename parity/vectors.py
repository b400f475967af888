"""Vector queries: version_id = vec_id div 5, chunk_id = vec_id % 5; paired sets are rows v and v + 1."""

from __future__ import annotations

from pyspark.sql import functions as F

from parity.registry import query, table
from parity.retrieval import DENSE
from versionlake.functions.scorers import (
    DenseScorer, MultiVectorScorer, SparseScorer, WeightedScorer)
from versionlake.functions import vectors as VF
from versionlake.functions.vectors import DISTANCE_MODES
from versionlake.operators import mining, numbering, ranking, tiles, vectors as V

DOT = "list_inner_product({0}, {1})"
CHUNKS = """
WITH c AS (SELECT vec_id // 5 AS id, (vec_id % 5)::INT AS chunk_id, label, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT *, sqrt(list_inner_product(e, e)) AS n FROM c),
lab AS (SELECT id, label FROM c WHERE chunk_id = 0),
cp AS (SELECT q.id AS query_id, c.id AS corpus_id, q.chunk_id AS s1, c.chunk_id AS s2,
              list_inner_product(q.e, c.e) / (q.n * c.n) AS sim,
              1 - list_inner_product(q.e, c.e) / ((q.n + 1e-6) * (c.n + 1e-6)) AS dist
       FROM u q JOIN u c ON q.id <> c.id)
"""
RANKED = """,
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY s DESC, corpus_id))::INT AS rank FROM sc)
SELECT query_id, corpus_id, round({0}, 6) AS score, rank, (a.label = b.label)::INT AS relevant
FROM r JOIN lab a ON a.id = query_id JOIN lab b ON b.id = corpus_id WHERE rank <= 10"""


def chunks(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 5).alias("id"), (F.col("vec_id") % 5).cast("int").alias("chunk_id"),
        "embedding", "label")


def stacked(spark, sf_dir):
    c = chunks(spark, sf_dir)
    return V.stack_chunks(c).join(c.where("chunk_id = 0").select("id", "label"), "id")


def top10(df, distance=False):
    score = -F.col("score") if distance else F.col("score")
    return df.withColumn("score", F.round(score, 6) + F.lit(0.0))


@query("mean_pool", """
SELECT vec_id // 5 AS id, pos::INT AS pos, round(avg(x), 6) AS value
FROM (SELECT vec_id, unnest(range(1, 65)) AS pos, unnest(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY ALL""")
def mean_pool(spark, sf_dir):
    return (V.mean_pool(chunks(spark, sf_dir)).select("id", F.posexplode("embedding").alias("pos", "value"))
            .select("id", (F.col("pos") + 1).alias("pos"), F.round("value", 6).alias("value")))


@query("chunked_topk", CHUNKS + """,
m AS (SELECT query_id, corpus_id, s1, max(sim) AS s FROM cp GROUP BY ALL),
sc AS (SELECT query_id, corpus_id, round(avg(s), 9) AS s FROM m GROUP BY ALL)""" + RANKED.format("s"))
def chunked_topk(spark, sf_dir):
    items = stacked(spark, sf_dir)
    return top10(tiles.top_k(items, items, MultiVectorScorer("vectors", "cosine", "meanmax"), 10))


@query("maxsim_topk", CHUNKS.replace("/ (q.n * c.n) AS sim", "AS sim") + """,
m AS (SELECT query_id, corpus_id, s1, max(sim) AS s FROM cp GROUP BY ALL),
sc AS (SELECT query_id, corpus_id, round(avg(s), 9) AS s FROM m GROUP BY ALL)""" + RANKED.format("s"))
def maxsim_topk(spark, sf_dir):
    items = stacked(spark, sf_dir)
    return top10(tiles.top_k(items, items, MultiVectorScorer("vectors", "dotsim", "meanmax"), 10))


@query("min_chunk_distance", CHUNKS + """,
sc AS (SELECT query_id, corpus_id, round(-min(1 - sim), 9) AS s FROM cp GROUP BY ALL)""" + RANKED.format("-s"))
def min_chunk_distance(spark, sf_dir):
    items = stacked(spark, sf_dir)
    return top10(tiles.top_k(items, items, MultiVectorScorer("vectors", "angle", "min"), 10), distance=True)


HYBRID = CHUNKS + """,
pooled AS (SELECT id, list(x ORDER BY pos) AS e FROM (
  SELECT id, pos, avg(x) AS x FROM (SELECT id, unnest(range(1, 65)) AS pos, unnest(e) AS x FROM c) GROUP BY ALL) GROUP BY id),
tw AS (SELECT id, label AS term, count(*) / 5.0::DOUBLE AS w FROM c GROUP BY ALL),
d AS (SELECT q.id AS query_id, c.id AS corpus_id, list_inner_product(q.e, c.e) AS dense
      FROM pooled q JOIN pooled c ON q.id <> c.id),
sp AS (SELECT q.id AS query_id, c.id AS corpus_id, sum(q.w * c.w) AS sparse FROM tw q JOIN tw c USING (term) GROUP BY ALL),
m AS (SELECT query_id, corpus_id, s1, max(sim * n1 * n2) AS s FROM (
        SELECT cp.*, a.n AS n1, b.n AS n2 FROM cp JOIN u a ON a.id = query_id AND a.chunk_id = s1
        JOIN u b ON b.id = corpus_id AND b.chunk_id = s2) GROUP BY ALL),
late AS (SELECT query_id, corpus_id, avg(s) AS late FROM m GROUP BY ALL),
sc AS (SELECT query_id, corpus_id, round((dense + coalesce(sparse, 0) + late) / 3, 9) AS s
       FROM d LEFT JOIN sp USING (query_id, corpus_id) JOIN late USING (query_id, corpus_id))""" + RANKED.format("s")


def hybrid_items(spark, sf_dir):
    """id, label, embedding, terms and weights, vectors of each version."""
    c = chunks(spark, sf_dir)
    words = (c.groupBy("id", F.col("label").cast("string").alias("term")).agg((F.count("*") / 5.0).alias("w"))
             .groupBy("id").agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("v"))
             .select("id", F.transform("v", lambda x: x["term"]).alias("terms"),
                     F.transform("v", lambda x: x["w"]).alias("weights")))
    return stacked(spark, sf_dir).join(V.mean_pool(c), "id").join(words, "id")


@query("hybrid_topk", HYBRID)
def hybrid_topk(spark, sf_dir):
    items = hybrid_items(spark, sf_dir)
    third = 1.0 / 3.0
    scorer = WeightedScorer([DenseScorer("embedding", "dotsim"), SparseScorer(),
                             MultiVectorScorer("vectors", "dotsim", "meanmax")], [third] * 3)
    return top10(tiles.top_k(items, items, scorer, 10))


FUSE = DENSE + """,
sizes AS (SELECT id, list_transform(e, lambda x: abs(x)) AS e FROM u),
b AS (SELECT q.id AS query_id, c.id AS corpus_id, round(list_inner_product(q.e, c.e), 9) AS b
      FROM sizes q JOIN sizes c ON q.id <> c.id),
ab AS (SELECT query_id, corpus_id, relevant, score AS a, b FROM pairs JOIN b USING (query_id, corpus_id)),
sc AS (SELECT query_id, corpus_id, relevant, round({0}, 9) AS s FROM ab),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY s DESC, corpus_id))::INT AS rank FROM sc)
SELECT query_id, corpus_id, round(s, {1}) AS score, rank, relevant FROM r WHERE rank <= 10"""


def fused(spark, sf_dir, method):
    e = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), "label", "embedding", F.transform("embedding", F.abs).alias("sizes"))
    scorer = ranking.fusion_scorer(DenseScorer("embedding", "cosine"), DenseScorer("sizes", "dotsim"), method)
    return ranking.rank_results(e, e, scorer, 10)


@query("fusion_mean", FUSE.format(
    "(exp(a) / sum(exp(a)) OVER (PARTITION BY query_id) + exp(b) / sum(exp(b)) OVER (PARTITION BY query_id)) / 2", 6))
def fusion_mean(spark, sf_dir):
    return top10(fused(spark, sf_dir, "mean"))


@query("fusion_max", FUSE.format("greatest(a, b)", 6))
def fusion_max(spark, sf_dir):
    return top10(fused(spark, sf_dir, "max"))


PAIRED = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT a.vec_id AS id, a.e AS a, b.e AS b, sqrt(list_inner_product(a.e, a.e)) AS na,
             sqrt(list_inner_product(b.e, b.e)) AS nb, list_inner_product(a.e, b.e) AS ab
      FROM v a JOIN v b ON b.vec_id = a.vec_id + 1),
s AS (SELECT id, ab / (na * nb) AS score FROM p)
"""


def paired(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return (e.select(F.col("vec_id").alias("id"), "embedding"),
            e.select((F.col("vec_id") - 1).alias("id"), "embedding"))


@query("distance_modes", PAIRED + """,
d AS (SELECT *, greatest(na * na - 2 * ab + nb * nb, 0) AS sq FROM p)
SELECT id, round(1 - ab / ((na + 1e-6) * (nb + 1e-6)), 6) AS cos, round(ab / ((na + 1e-6) * (nb + 1e-6)), 6) AS cossim,
  round(1 - ab, 6) AS dot, round(ab, 6) AS dotsim, round(sqrt(sq), 6) AS euc, round(sqrt(sq) / 8, 6) AS neuc,
  round(sq, 6) AS sqeuc, round(sq / 64, 6) AS nsqeuc, round(sqrt(sq), 6) AS fro, round(sqrt(sq) / 8, 6) AS nfro FROM d""")
def distance_modes(spark, sf_dir):
    a, b = paired(spark, sf_dir)
    pairs = a.withColumnRenamed("embedding", "a").join(b.withColumnRenamed("embedding", "b"), "id")
    return V.pair_distances(pairs, "a", "b").select("id", *[F.round(m, 6).alias(m) for m in DISTANCE_MODES])


@query("paired_similarity", PAIRED + """
SELECT round(avg(score), 6) AS mean, round(stddev_pop(score), 6) AS std, count(*) AS n FROM s""")
def paired_similarity(spark, sf_dir):
    out = V.paired_summary(V.paired_cosine(*paired(spark, sf_dir)))
    return out.select(F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


@query("mismatched_pairs", PAIRED + "SELECT id, round(score, 6) AS score FROM s WHERE score < 0")
def mismatched_pairs(spark, sf_dir):
    return V.mismatched(V.paired_cosine(*paired(spark, sf_dir)), 0.0).withColumn("score", F.round("score", 6))


@query("similarity_histogram", PAIRED + """,
r AS (SELECT min(score) AS lo, max(score) AS hi FROM s),
b AS (SELECT least(floor((score - lo) / ((hi - lo) / 20)) + 1, 20)::INT AS bin FROM s, r),
k AS (SELECT bin, count(*) AS n FROM b GROUP BY bin)
SELECT i::INT AS bin, round(lo + (i - 1) * (hi - lo) / 20, 6) AS low, round(lo + i * (hi - lo) / 20, 6) AS high,
       coalesce(n, 0)::BIGINT AS n
FROM (SELECT unnest(range(1, 21)) AS i) JOIN r ON true LEFT JOIN k ON bin = i""")
def similarity_histogram(spark, sf_dir):
    out = V.histogram(V.paired_cosine(*paired(spark, sf_dir)))
    return out.withColumns({"low": F.round("low", 6), "high": F.round("high", 6)})


@query("aggregate_pairs", """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
l AS (SELECT vec_id // 5 AS version_id, unnest(range(1, 65)) AS pos, unnest(e) AS x FROM v),
r AS (SELECT (vec_id - 1) // 5 AS version_id, unnest(range(1, 65)) AS pos, unnest(e) AS x FROM v WHERE vec_id > 0),
la AS (SELECT version_id, pos, avg(x) AS x FROM l GROUP BY ALL),
ra AS (SELECT version_id, pos, avg(x) AS x FROM r GROUP BY ALL)
SELECT version_id, round(sum(la.x * ra.x) / (sqrt(sum(la.x * la.x)) * sqrt(sum(ra.x * ra.x))), 6) AS score
FROM la JOIN ra USING (version_id, pos) GROUP BY version_id""")
def aggregate_pairs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    left = e.select(F.floor(F.col("vec_id") / 5).alias("version_id"), "embedding")
    right = e.where("vec_id > 0").select(F.floor((F.col("vec_id") - 1) / 5).alias("version_id"), "embedding")
    both = V.aggregate_pairs(left, right)
    return both.select("version_id", F.round(V.V.cosine(F.col("embedding_a"), F.col("embedding_b")), 6).alias("score"))


@query("pca2")
def pca2(spark, sf_dir):
    a, b = paired(spark, sf_dir)
    pairs = V.aligned_segments(a, b, "id")
    return V.pca_pairs(pairs, "id").select("id", "side", F.round(F.element_at("components", 1), 6).alias("x"),
                                           F.round(F.element_at("components", 2), 6).alias("y"))


@query("aligned_segments", """
SELECT a.vec_id AS id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS product
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 3 <> 1""")
def aligned_segments(spark, sf_dir):
    """Rows that two sets have in common: vectors without every third, and each with the one after it."""
    e = table(spark, sf_dir, "embeddings")
    left = e.where("vec_id % 3 <> 1").select(F.col("vec_id").alias("uid"), "embedding")
    right = e.select((F.col("vec_id") - 1).alias("uid"), "embedding")
    out = V.aligned_segments(left, right)
    return out.select(F.col("uid").alias("id"), F.round(VF.dot(F.col("embedding_a"), F.col("embedding_b")), 6).alias("product"))


@query("covariance_penalty", """
WITH x AS (SELECT vec_id, unnest(range(1, 65)) AS i, unnest(embedding::DOUBLE[]) AS v FROM embeddings),
p AS (SELECT a.i, b.i AS j, covar_samp(a.v, b.v) AS c FROM x a JOIN x b ON a.vec_id = b.vec_id AND a.i < b.i GROUP BY ALL)
SELECT round(1e6 * avg(c * c), 6) AS penalty FROM p""")
def covariance_penalty(spark, sf_dir):
    return V.covariance_penalty(table(spark, sf_dir, "embeddings"), width=24).select(
        F.round(1e6 * F.col("penalty"), 6).alias("penalty"))


@query("nearest_rank_quantiles", """
WITH o AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS r, count(*) OVER () AS n FROM events)
SELECT max(value) FILTER (r = round_even(0.1 * (n - 1), 0)) AS q10,
       max(value) FILTER (r = round_even(0.5 * (n - 1), 0)) AS q50,
       max(value) FILTER (r = round_even(0.9 * (n - 1), 0)) AS q90 FROM o""")
def nearest_rank_quantiles(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    found = numbering.quantiles(events, "value", [0.1, 0.5, 0.9], "nearest")
    return found.agg(*[F.max(F.when(F.col("probability") == q, F.col("value"))).alias(n)
                       for q, n in ((0.1, "q10"), (0.5, "q50"), (0.9, "q90"))])


@query("masked_summary", """
SELECT user_id, round(coalesce(sum(value) FILTER (event_type <> 'error'), 0), 6) AS msum,
       round(coalesce(avg(value) FILTER (event_type <> 'error'), 0), 6) AS mmean,
       min(value) FILTER (event_type <> 'error') AS mmin, max(value) FILTER (event_type <> 'error') AS mmax
FROM events GROUP BY user_id""")
def masked_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("mask", F.col("event_type") == "error")
    out = V.masked_summary(e, ["user_id"], "value", "mask")
    return out.withColumns({"msum": F.round("msum", 6), "mmean": F.round("mmean", 6)})


# ---------------------------------------------------------------- shingle reductions

def redux_sql(expression, dist="dist"):
    return CHUNKS + f",\nsc AS ({expression.format(d=dist)})" + RANKED.format("-s")


BY_PAIR = "SELECT query_id, corpus_id, round(-({0}), 9) AS s FROM {1} GROUP BY query_id, corpus_id"
ROW_MIN = "(SELECT query_id, corpus_id, s1, min(dist) AS x FROM cp GROUP BY ALL)"
COL_MIN = "(SELECT query_id, corpus_id, s2, min(dist) AS x FROM cp GROUP BY ALL)"
SHINGLE = {
    "max": BY_PAIR.format("max(dist)", "cp"),
    "mean": BY_PAIR.format("avg(dist)", "cp"),
    "minmean": BY_PAIR.format("min(x)", "(SELECT query_id, corpus_id, s1, avg(dist) AS x FROM cp GROUP BY ALL)"),
    "meanmin": BY_PAIR.format("avg(x)", ROW_MIN),
    "smeanmin": f"""SELECT query_id, corpus_id, round(-(0.5 * (a + b)), 9) AS s
        FROM (SELECT query_id, corpus_id, avg(x) AS a FROM {ROW_MIN} GROUP BY ALL)
        JOIN (SELECT query_id, corpus_id, avg(x) AS b FROM {COL_MIN} GROUP BY ALL) USING (query_id, corpus_id)""",
    "best-3": BY_PAIR.format("list_avg(list_sort(list(dist))[1:3])", "cp"),
    "worst-3": BY_PAIR.format("list_avg(list_reverse_sort(list(dist))[1:3])", "cp"),
    "bestmin-2": BY_PAIR.format("list_avg(list_sort(list(x))[1:2])", ROW_MIN),
}


def _shingle(redux):
    def run(spark, sf_dir):
        items = stacked(spark, sf_dir)
        return top10(tiles.top_k(items, items, MultiVectorScorer("vectors", "cos", redux), 10), distance=True)
    return run


for _name, _sql in SHINGLE.items():
    query(f"shingle_{_name.replace('-', '_')}", redux_sql(_sql))(_shingle(_name))


def picks_sql(picks: int) -> str:
    """Mean of the smallest distances, each pick without the rows and columns of the picks before it."""
    out = CHUNKS + """,
left0 AS MATERIALIZED (SELECT q.id AS query_id, c.id AS corpus_id, q.chunk_id AS s1, c.chunk_id AS s2,
         greatest(q.n * q.n - 2 * list_inner_product(q.e, c.e) + c.n * c.n, 0) / 64 AS d FROM u q JOIN u c ON q.id <> c.id)"""
    for i in range(picks):
        out += f""",
pick{i} AS MATERIALIZED (SELECT query_id, corpus_id, min({{'d': d, 'a': s1, 'b': s2}}) AS m FROM left{i} GROUP BY ALL),
left{i + 1} AS MATERIALIZED (SELECT l.* FROM left{i} l JOIN pick{i} USING (query_id, corpus_id) WHERE s1 <> m.a AND s2 <> m.b)"""
    every = " UNION ALL ".join(f"SELECT query_id, corpus_id, m.d AS d FROM pick{i}" for i in range(picks))
    return out + f""",
sc AS (SELECT query_id, corpus_id, round(-avg(d), 9) AS s FROM ({every}) GROUP BY ALL)""" + RANKED.format("-s")


@query("shingle_bpwr_5", picks_sql(5))
def shingle_bpwr_5(spark, sf_dir):
    items = stacked(spark, sf_dir)
    return top10(tiles.top_k(items, items, MultiVectorScorer("vectors", "nsqeuc", "bpwr-5"), 10), distance=True)


MASKED = "vec_id % 7 = 3 OR vec_id // 5 % 11 = 4"


@query("clews_masked", picks_sql(5).replace("AS e FROM embeddings)", f"AS e FROM embeddings WHERE NOT ({MASKED}))", 1)
       .replace("lab AS (SELECT id, label FROM c WHERE chunk_id = 0)",
                "lab AS (SELECT vec_id // 5 AS id, label FROM embeddings WHERE vec_id % 5 = 0)"))
def clews_masked(spark, sf_dir):
    """Shingles with a mask; every eleventh record is masked as a whole."""
    c = chunks(spark, sf_dir)
    masks = c.groupBy("id").agg(F.sort_array(F.collect_list(F.struct(
        "chunk_id", F.expr(MASKED.replace("//", "div").replace("vec_id", "(id * 5 + chunk_id)")).alias("mask")))).alias("m"))
    items = tiles.unmasked(stacked(spark, sf_dir).join(masks.select("id", F.col("m")["mask"].alias("mask")), "id"))
    return top10(tiles.top_k(items, items, tiles.model_scorer("clews"), 10), distance=True)


# ---------------------------------------------------------------- batches

BATCH = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT a.vec_id AS id, a.vec_id // 50 AS batch_id, a.e AS a, b.e AS b FROM v a JOIN v b ON b.vec_id = a.vec_id + 1),
s AS (SELECT x.batch_id, x.id AS i, y.id AS j, round(list_inner_product(x.a, y.b), 9) AS sim,
             list_inner_product(x.a, y.b) / sqrt(list_inner_product(x.a, x.a) * list_inner_product(y.b, y.b)) AS xc,
             list_inner_product(x.a, y.a) / sqrt(list_inner_product(x.a, x.a) * list_inner_product(y.a, y.a)) AS aa,
             list_inner_product(x.b, y.b) / sqrt(list_inner_product(x.b, x.b) * list_inner_product(y.b, y.b)) AS bb
      FROM p x JOIN p y USING (batch_id))
"""


def batches(spark, sf_dir):
    a, b = paired(spark, sf_dir)
    return (a.withColumnRenamed("embedding", "embedding_a").join(b.withColumnRenamed("embedding", "embedding_b"), "id")
            .withColumn("batch_id", F.floor(F.col("id") / 50)))


@query("inbatch_metrics", BATCH + """,
r AS (SELECT o.batch_id, o.i, o.sim AS own, 1 + count(*) FILTER (s.sim > o.sim OR (s.sim = o.sim AND s.j < o.i)) AS rank
      FROM (SELECT * FROM s WHERE i = j) o JOIN s ON s.batch_id = o.batch_id AND s.i = o.i GROUP BY ALL)
SELECT batch_id, round(avg((rank <= 1)::INT), 6) AS HR1, round(avg((rank <= 5)::INT), 6) AS HR5,
       round(avg((rank <= 10)::INT), 6) AS HR10,
       round(avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE / rank ELSE 0 END), 6) AS MAP10,
       round(avg(own), 6) AS cosine_sim FROM r GROUP BY batch_id""")
def inbatch_metrics(spark, sf_dir):
    out = V.retrieval_in_batch(batches(spark, sf_dir))
    return out.select("batch_id", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query("alignment_report", BATCH + """,
z AS (SELECT *, ln(sum(exp(xc / 0.07)) OVER (PARTITION BY batch_id, i)) AS zr FROM s),
t AS (SELECT batch_id, 1 - avg(xc) FILTER (i = j) AS l_cos, avg((aa - bb) * (aa - bb)) AS l_mse,
             avg(zr - xc / 0.07) FILTER (i = j) AS contrastive
      FROM z GROUP BY batch_id)
SELECT batch_id, round(l_cos, 6) AS l_cos, round(l_mse, 6) AS l_mse, round(0.5 * l_cos + 0.5 * l_mse, 6) AS total,
       round(contrastive, 6) AS contrastive FROM t""")
def alignment_report(spark, sf_dir):
    out = V.alignment_in_batch(batches(spark, sf_dir))
    return out.select("batch_id", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query("frame_shift", """
WITH c AS (SELECT vec_id // 10 AS perf, (vec_id % 10)::INT AS idx, embedding::DOUBLE[] AS e FROM embeddings),
p AS (SELECT DISTINCT a.perf AS perf_i, b.perf AS perf_j FROM c a JOIN c b ON b.perf = a.perf + 1),
d AS (SELECT perf_i, perf_j, a.idx AS idx_i, b.idx AS idx_j,
             round(sqrt(list_inner_product(a.e, a.e) - 2 * list_inner_product(a.e, b.e) + list_inner_product(b.e, b.e)), 9) AS dist
      FROM p JOIN c a ON a.perf = perf_i JOIN c b ON b.perf = perf_j AND a.idx <> b.idx),
n AS (SELECT *, row_number() OVER (PARTITION BY perf_i, perf_j, idx_i ORDER BY dist, idx_j) AS r FROM d),
t AS (SELECT perf_i, perf_j, idx_i - idx_j AS delta, count(*) AS k, min(idx_i) AS seen FROM n WHERE r = 1 GROUP BY ALL)
SELECT perf_i, perf_j, delta AS shift_frame_i_to_j FROM t
QUALIFY row_number() OVER (PARTITION BY perf_i, perf_j ORDER BY k DESC, seen) = 1""")
def frame_shift(spark, sf_dir):
    c = table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 10).alias("perf"), (F.col("vec_id") % 10).cast("int").alias("idx"), "embedding")
    perfs = c.select("perf").distinct()
    pairs = (perfs.select(F.col("perf").alias("perf_i"), (F.col("perf") + 1).alias("perf_j"))
             .join(perfs.select(F.col("perf").alias("perf_j")), "perf_j", "left_semi"))
    return V.frame_shift(c, pairs)


@query("frame_shift_all", """
WITH c AS (SELECT vec_id // 10 AS perf, (vec_id % 10)::INT AS idx, vec_id // 10 % 7 AS work, embedding::DOUBLE[] AS e FROM embeddings),
d AS (SELECT a.perf AS perf_i, b.perf AS perf_j, a.idx AS idx_i, b.idx AS idx_j,
             round(sqrt(list_inner_product(a.e, a.e) - 2 * list_inner_product(a.e, b.e) + list_inner_product(b.e, b.e)), 9) AS dist
      FROM c a JOIN c b ON a.work = b.work AND a.perf <> b.perf AND a.idx <> b.idx),
n AS (SELECT *, row_number() OVER (PARTITION BY perf_i, perf_j, idx_i ORDER BY dist, idx_j) AS r FROM d),
t AS (SELECT perf_i, perf_j, idx_i - idx_j AS delta, count(*) AS k, min(idx_i) AS seen FROM n WHERE r = 1 GROUP BY ALL)
SELECT perf_i, perf_j, delta AS shift_frame_i_to_j FROM t
QUALIFY row_number() OVER (PARTITION BY perf_i, perf_j ORDER BY k DESC, seen) = 1
UNION ALL SELECT DISTINCT perf, perf, 0 FROM c""")
def frame_shift_all(spark, sf_dir):
    """All ordered pairs of a work; seven works, so that each has more chunks than a cell of 64."""
    perf = F.floor(F.col("vec_id") / 10)
    c = table(spark, sf_dir, "embeddings").select(
        perf.alias("perf"), (perf % 7).alias("work"), (F.col("vec_id") % 10).cast("int").alias("idx"), "embedding")
    return V.frame_shift_all(c, "work", cell_rows=64)


# ---------------------------------------------------------------- mining

def labelled(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", "embedding")


@query("clique_outliers", DENSE + """
SELECT query_id AS id, any_value(q.label) AS label, round(avg(score), 6) AS mean_similarity, count(*) + 1 AS clique_size
FROM pairs JOIN u q ON q.id = query_id WHERE relevant = 1 GROUP BY query_id HAVING avg(score) < 0.01""")
def clique_outliers(spark, sf_dir):
    return mining.clique_outliers(labelled(spark, sf_dir), 0.01).withColumn(
        "mean_similarity", F.round("mean_similarity", 6))


@query("hard_negatives", """
WITH v AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS e FROM embeddings),
p AS MATERIALIZED (SELECT a.id AS anchor, b.id AS positive, a.label, a.e, round(list_inner_product(a.e, b.e), 9) AS s
      FROM v a JOIN v b ON a.label = b.label AND a.id < b.id WHERE round(list_inner_product(a.e, b.e), 9) >= 0.3),
n AS (SELECT anchor, positive, id AS hard_negative, s, round(list_inner_product(p.e, v.e), 9) AS t
      FROM p JOIN v ON v.label <> p.label)
SELECT anchor, positive, round(s, 6) AS sim_ap, hard_negative, round(t, 6) AS sim_an FROM n WHERE t > s""")
def hard_negatives(spark, sf_dir):
    out = mining.hard_negatives(labelled(spark, sf_dir), 0.3)
    return out.withColumns({"sim_ap": F.round("sim_ap", 6), "sim_an": F.round("sim_an", 6)})
