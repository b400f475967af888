"""Ids, joins, splits, shards, reports and re-ranking over the driver tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from parity.registry import query, table
from parity.retrieval import DENSE, METRICS, SCORER, dense_inputs, dense_parts
from parity.segments import SEG, segment_table
from parity import vectors
from parity.texts import TOKENS
from versionlake.functions import text as X
from versionlake.functions.scorers import DenseScorer
from versionlake.operators import ids, infer, lexical, ranking, reports, rerank, segments as S, splits, tiles
from versionlake.plans import evaluate
from versionlake.session import reliable_checkpoint, spread_small
from versionlake.sources import readers, writers


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def recordings(spark, sf_dir):
    """version_id `V-<source>_<doc>`, one work a source."""
    return documents(spark, sf_dir).select(
        F.concat_ws("", F.lit("V-"), "source", F.lit("_"), "doc_id").alias("version_id"),
        F.col("source").alias("clique_id"), F.concat_ws(".", F.md5(F.col("doc_id").cast("string")), F.lit("tar.mp3")).alias("file"),
        "doc_id", "text", "n_chars")


REC = """
WITH r AS (SELECT 'V-' || source || '_' || doc_id AS version_id, source AS clique_id,
                  md5(doc_id::VARCHAR) AS md5_encoded, doc_id, text, n_chars FROM documents)
"""


@query("uid_build", REC + """
SELECT version_id, md5_encoded, replace(replace(version_id, 'V-', ''), '_', '') || (doc_id % 10) AS uid,
       substr(replace(replace(version_id, 'V-', ''), '_', '') || (doc_id % 10), 1, 3) || '/'
         || replace(replace(version_id, 'V-', ''), '_', '') || (doc_id % 10) AS path,
       (doc_id % 10)::VARCHAR AS chunk_back,
       'audio/' || md5_encoded || '.mp3' AS audio FROM r""")
def uid_build(spark, sf_dir):
    df = ids.with_md5(recordings(spark, sf_dir)).withColumn(
        "uid", ids.chunk_uid(F.col("version_id"), F.col("doc_id") % 10))
    back = ids.split_uid(df.select("uid", F.col("version_id").alias("v"), "md5_encoded"))
    out = back.select(F.col("v").alias("version_id"), "md5_encoded", "uid", F.col("chunk_id").alias("chunk_back"))
    return ids.audio_path(out, "audio").withColumnRenamed("path", "audio").withColumn(
        "path", ids.fan_out_path(F.col("uid")))


@query("merge_sources", """
SELECT d.doc_id AS version_id, md5(d.text) AS transcription, l.quality AS segments, l.toxic AS vocalness
FROM documents d JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL""")
def merge_sources(spark, sf_dir):
    d = documents(spark, sf_dir)
    meta = d.select(F.col("doc_id").alias("version_id"), F.col("doc_id").alias("md5_encoded"))
    texts = ids.normalize_transcripts(d.select(F.col("doc_id").alias("md5_encoded"), F.col("text").alias("transcription")))
    vocals = ids.normalize_vocals(table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("md5_encoded"), F.col("quality").alias("vocal_segments"), F.col("toxic").alias("vocalness_score")))
    return ids.merge_sources(meta, texts, vocals).select(
        "version_id", F.md5("transcription_vocal").alias("transcription"), "segments", "vocalness")


@query("rename_keys", """
SELECT d.source || '_' || d.doc_id AS version_id, l.quality FROM labels l JOIN documents d USING (doc_id)""")
def rename_keys(spark, sf_dir):
    meta = documents(spark, sf_dir).select(F.col("doc_id").alias("md5_encoded"), F.concat_ws("_", "source", "doc_id").alias("version_id"))
    vectors = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("md5_encoded"), "quality")
    return ids.rename_keys(vectors, meta).select("version_id", "quality")


@query("overlap_map", """
SELECT c.conv_id AS query_pos, d.doc_id AS ref_pos FROM (SELECT DISTINCT conv_id FROM conversations) c
JOIN documents d ON d.doc_id = c.conv_id * 3""")
def overlap_map(spark, sf_dir):
    q = table(spark, sf_dir, "conversations").select("conv_id").distinct().select(
        (F.col("conv_id") * 3).alias("perf"), F.col("conv_id").alias("position"))
    return ids.overlap_map(q, documents(spark, sf_dir).select(F.col("doc_id").alias("perf"), F.col("doc_id").alias("position")))


@query("resume_pending", "SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_pending(spark, sf_dir):
    return ids.pending(documents(spark, sf_dir).select("doc_id", "n_chars"), table(spark, sf_dir, "labels"), "doc_id")


@query("filter_truth", """
SELECT a.doc_id AS query_id, a.doc_id + 1 AS corpus_id FROM documents a
WHERE a.doc_id IN (SELECT doc_id FROM labels) AND a.doc_id + 1 IN (SELECT doc_id FROM labels)""")
def filter_truth(spark, sf_dir):
    truth = documents(spark, sf_dir).select(F.col("doc_id").alias("query_id"), (F.col("doc_id") + 1).alias("corpus_id"))
    return ids.filter_truth(truth, table(spark, sf_dir, "labels"), "doc_id")


@query("parse_literals", """
SELECT event_id, round(value, 6) AS start, round(value + 1.5, 6) AS "end", (event_type = 'click') AS flag FROM events""")
def parse_literals(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    start, end = F.col("value").cast("string"), F.round(F.col("value") + 1.5, 6).cast("string")
    flag = F.when(F.col("event_type") == "click", "True").otherwise("False")
    cells = e.select("event_id", F.concat(F.lit("[("), start, F.lit(", "), end, F.lit("),]")).alias("pairs"),
                     F.concat(F.lit("[{'ok': "), flag, F.lit("}]")).alias("flags"))
    out = cells.select("event_id", readers.parse_pairs(F.col("pairs"))[0].alias("p"),
                       readers.parse_literal(F.col("flags"), "array<struct<ok:boolean>>")[0]["ok"].alias("flag"))
    return out.select("event_id", F.round("p.start", 6).alias("start"), F.round("p.end", 6).alias("end"), "flag")


@query("line_fields", """
SELECT event_id, event_type AS perf, 'a:' || user_id AS work, user_id::INT AS len FROM events""")
def line_fields(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    tabbed = F.concat(F.lit("perf:"), F.col("event_type"), F.lit("\twork:a:"), F.col("user_id"), F.lit("\tlen:"), F.col("user_id"))
    json = F.to_json(F.struct(F.col("event_type").alias("perf"), F.concat(F.lit("a:"), F.col("user_id")).alias("work"),
                              F.col("user_id").alias("len")))
    line = F.when(F.col("event_id") % 2 == 0, tabbed).otherwise(json)
    f = e.select("event_id", readers.line_fields(line).alias("f"))
    return f.select("event_id", F.col("f")["perf"].alias("perf"), F.col("f")["work"].alias("work"),
                    F.col("f")["len"].cast("int").alias("len"))


@query("exact_duration", SEG + """SELECT user_id, start, "end" FROM merged WHERE "end" - start = 3.0""")
def exact_duration(spark, sf_dir):
    merged = S.merge_vocal(segment_table(spark, sf_dir), "user_id")
    return ids.exact_duration(merged, 3.0).select("user_id", "start", "end")


@query("speed_variants", """
SELECT CASE WHEN s = 1.0 THEN doc_id::VARCHAR ELSE 'sp_' || s || '-' || doc_id END AS perf, s AS speed,
       CASE WHEN s = 1.0 THEN n_chars::DOUBLE ELSE round(n_chars / s, 2) END AS dur_s
FROM documents, (SELECT unnest([0.8::DOUBLE, 1.0::DOUBLE, 1.2::DOUBLE]) AS s)""")
def speed_variants(spark, sf_dir):
    df = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("perf"), F.col("n_chars").cast("double").alias("dur_s"))
    return ids.speed_variants(df, [0.8, 1.0, 1.2])


@query("drop_speed_variants", "SELECT doc_id::VARCHAR AS perf, n_chars::DOUBLE AS dur_s, 1.0::DOUBLE AS speed FROM documents")
def drop_speed_variants(spark, sf_dir):
    return ids.drop_speed_variants(speed_variants(spark, sf_dir))


@query("tag_union", """
SELECT doc_id, quality, NULL::BIGINT AS n_chars, 'labels' AS type FROM labels
UNION ALL SELECT doc_id, NULL, n_chars, 'documents' FROM documents""")
def tag_union(spark, sf_dir):
    return ids.tag_union({"labels": table(spark, sf_dir, "labels").select("doc_id", "quality"),
                          "documents": documents(spark, sf_dir).select("doc_id", "n_chars")})


@query("work_ids", """
WITH f AS (SELECT source AS work, min(doc_id) AS first FROM documents GROUP BY source),
w AS (SELECT work, (row_number() OVER (ORDER BY first) - 1)::INT AS work_id FROM f)
SELECT doc_id, source AS work, work_id FROM documents JOIN w ON work = source""")
def work_ids(spark, sf_dir):
    df = documents(spark, sf_dir).select("doc_id", F.col("source").alias("work"))
    return ids.add_work_ids(df, "doc_id")[0].select("doc_id", "work", "work_id")


@query("dedupe_perf", "SELECT md5(text) AS perf, min(doc_id) AS doc_id FROM documents GROUP BY ALL")
def dedupe_perf(spark, sf_dir):
    df = documents(spark, sf_dir).select(F.md5("text").alias("perf"), "doc_id")
    return ids.dedupe_perfs(df, ["doc_id"])


@query("clique_checks", """
SELECT md5(text) AS clique_id, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) < 2""")
def clique_checks(spark, sf_dir):
    return ids.small_cliques(documents(spark, sf_dir).select(F.md5("text").alias("clique_id")))


@query("clique_overlap", """
SELECT source AS clique_id FROM documents WHERE lang = 'fr' INTERSECT SELECT source FROM documents WHERE lang = 'es'""")
def clique_overlap(spark, sf_dir):
    d = documents(spark, sf_dir).withColumnRenamed("source", "clique_id")
    return ids.clique_overlap(d.where("lang = 'fr'"), d.where("lang = 'es'"))


@query("clique_ids", """
WITH s AS (SELECT lang, source AS clique_id, count(*) AS n FROM documents GROUP BY ALL)
SELECT lang AS split, clique_id, row_number() OVER (ORDER BY lang, clique_id) - 1 AS dense_id, n FROM s""")
def clique_ids(spark, sf_dir):
    d = documents(spark, sf_dir).withColumnRenamed("source", "clique_id")
    return ids.clique_ids({s: d.where(F.col("lang") == s) for s in ("de", "en", "es", "fr")})


@query("label_consistency", """
SELECT lang AS perf, min(source) AS low, max(source) AS high FROM documents GROUP BY lang HAVING min(source) <> max(source)""")
def label_consistency(spark, sf_dir):
    return ids.inconsistent_labels(documents(spark, sf_dir), "lang", "source").withColumnRenamed("lang", "perf")


# ---------------------------------------------------------------- splits

HASHED = """
WITH n AS (SELECT count(*) AS n FROM documents),
o AS (SELECT doc_id, source, row_number() OVER (ORDER BY md5('42|' || doc_id)) AS r FROM documents)
"""


@query("split_counts", HASHED + """,
b AS (SELECT n, round_even(0.8 * n, 0) AS t, round_even(0.5 * (n - round_even(0.8 * n, 0)), 0) AS v FROM n)
SELECT doc_id, CASE WHEN r <= t THEN 'train' WHEN r <= t + v THEN 'val' ELSE 'test' END AS split FROM o, b""")
def split_counts(spark, sf_dir):
    return splits.train_val_test(documents(spark, sf_dir).select("doc_id"), "doc_id")


@query("quartiles", SEG + """,
q AS (SELECT quantile_cont(score, 0.25) AS a, quantile_cont(score, 0.5) AS b, quantile_cont(score, 0.75) AS c FROM verdict)
SELECT user_id, round(score, 6) AS score, 'q1' AS subset FROM verdict, q WHERE score >= a
UNION ALL SELECT user_id, round(score, 6), 'median' FROM verdict, q WHERE score >= b
UNION ALL SELECT user_id, round(score, 6), 'q3' FROM verdict, q WHERE score >= c""")
def quartiles(spark, sf_dir):
    scores = S.accept_tracks(segment_table(spark, sf_dir), "user_id").select("user_id", F.col("vocalness_score").alias("score"))
    # averages differ in the last bit between evaluations with another row order: fix them before comparing
    scores = scores.withColumn("score", F.round("score", 12))
    return ids.tag_union(splits.quartile_subsets(scores, "score"), "subset").withColumn("score", F.round("score", 6))


@query("work_split", """
WITH w AS (SELECT source, count(*) AS n, row_number() OVER (ORDER BY md5('7|' || source)) AS wr, count(*) OVER () AS nw
           FROM documents GROUP BY source),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('7|' || source || '|' || doc_id)) AS r FROM documents)
SELECT doc_id, source, CASE WHEN wr <= greatest(1, floor(nw * 0.1)) THEN 'test'
  WHEN wr <= greatest(1, floor(nw * 0.1)) + greatest(1, floor(nw * 0.15)) THEN 'val'
  WHEN r <= greatest(1, floor(n * 0.2)) THEN 'val'
  WHEN r <= greatest(1, floor(n * 0.2)) + greatest(1, floor(n * 0.1)) THEN 'test' ELSE 'train' END AS split
FROM r JOIN w USING (source)""")
def work_split(spark, sf_dir):
    return splits.split_by_work(documents(spark, sf_dir).select("doc_id", "source"), "doc_id", "source",
                                val_unseen=0.15, test_unseen=0.1, val_ratio=0.2, test_ratio=0.1, seed=7)


@query("work_split_ratio", """
WITH RECURSIVE w AS (
  SELECT supplier AS source, n, row_number() OVER (ORDER BY md5('7|' || supplier)) AS wr, count(*) OVER () AS nw
  FROM (SELECT l_suppkey AS supplier, count(*) AS n FROM lineitem GROUP BY ALL)),
h AS (SELECT *, greatest(1, floor(nw * 0.1)) AS n_test, greatest(1, floor(nw * 0.1)) + greatest(1, floor(nw * 0.15)) AS n_held,
             greatest(1, floor(n * 0.2)) AS v, greatest(1, floor(n * 0.1)) AS t FROM w),
walk AS (
  SELECT max(n_held) AS i, sum(n) FILTER (wr <= n_test) AS test, 0::DOUBLE AS train, NULL::BIGINT AS source, 0::DOUBLE AS took FROM h
  UNION ALL
  SELECT wr, test + least(took, greatest(n - v, 0)), train + greatest(n - v - took, 0), source, took
  FROM (SELECT h.wr, h.n, h.v, h.source, test, train,
               CASE WHEN train > 0 AND test / train > 0.1 THEN greatest(1, t - 1) ELSE t END AS took
        FROM walk JOIN h ON h.wr = walk.i + 1)),
r AS (SELECT l_suppkey AS source, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey
             ORDER BY md5('7|' || l_suppkey || '|' || l_orderkey || '-' || l_linenumber)) AS r FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN wr <= n_test THEN 'test' WHEN wr <= n_held THEN 'val' WHEN r <= v THEN 'val'
  WHEN r <= v + took THEN 'test' ELSE 'train' END AS split
FROM r JOIN h USING (source) LEFT JOIN walk USING (source)""")
def work_split_ratio(spark, sf_dir):
    """Order lines by supplier, with the running ratio of test to train; ranges of seven works show the carry."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", F.concat_ws(
        "-", "l_orderkey", "l_linenumber").alias("line"))
    out = splits.split_by_work(lines, "line", "l_suppkey", val_unseen=0.15, test_unseen=0.1, val_ratio=0.2,
                               test_ratio=0.1, seed=7, keep_ratio=True, range_works=7)
    return out.select("l_orderkey", "l_linenumber", "split")


@query("kfold", """
SELECT doc_id, ((row_number() OVER (PARTITION BY source ORDER BY md5('42|' || doc_id)) - 1
  + ('0x' || substr(md5('42|' || source), 1, 8))::BIGINT % 5) % 5)::INT AS fold FROM documents""")
def kfold(spark, sf_dir):
    return splits.stratified_folds(documents(spark, sf_dir).select("doc_id", "source"), "doc_id", "source").select("doc_id", "fold")


def ring_sql(digits: str, step: str, size: str) -> str:
    """Place of a pick on a ring, from 32 hex digits."""
    first, second = (f"('0x' || substr({digits}, {at}, 8))::BIGINT" for at in (1, 9))
    return f"(({second} + ({step}) * ({splits.STRIDES}[{first} % {len(splits.STRIDES)} + 1] % ({size}))) % ({size}))"


@query("m_per_class", f"""
WITH d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42|' || doc_id)) AS pick FROM documents),
s AS (SELECT source, count(*) AS n, count(*) * CASE WHEN count(*) < 4 THEN ceil(4.0 / count(*))::BIGINT ELSE 1 END AS ring,
             row_number() OVER (ORDER BY md5('42|' || source)) - 1 AS class FROM documents GROUP BY source),
t AS (SELECT (sum(ring) // 32)::BIGINT AS batches, count(*) AS classes FROM s),
b AS (SELECT unnest(range(batches)) AS batch_id, classes FROM t),
c AS (SELECT batch_id, classes, unnest(range(least(8, classes))) AS c, md5('42|batch|' || batch_id) AS h FROM b),
p AS (SELECT batch_id, c, {ring_sql('h', 'c', 'classes')} AS class FROM c),
i AS (SELECT batch_id, c, source, n, ring, unnest(range(4)) AS i, md5('42|' || batch_id || '|' || source) AS h
      FROM p JOIN s USING (class)),
k AS (SELECT batch_id, (c * 4 + i)::INT AS slot, source, {ring_sql('h', 'i', 'ring')} % n + 1 AS pick FROM i)
SELECT batch_id, slot, source, doc_id FROM k JOIN d USING (source, pick)""")
def m_per_class(spark, sf_dir):
    return splits.per_class_batches(documents(spark, sf_dir), "doc_id", "source", m=4, batch_size=32)


@query("anchor_groups", f"""
WITH p AS (SELECT doc_id, source, n_chars / 10.0::DOUBLE AS len, count(*) OVER (PARTITION BY source) AS n, md5('42|walk|' || doc_id) AS h,
                  row_number() OVER (PARTITION BY source ORDER BY md5('42|' || doc_id)) - 1 AS place FROM documents),
s AS (SELECT *, unnest([0, 1, 2, 3]) AS slot FROM p WHERE n >= 2),
a AS (SELECT doc_id AS anchor, source, slot, CASE WHEN slot = 0 THEN place
             ELSE (place + 1 + {ring_sql('h', 'slot - 1', 'n - 1')}) % n END AS place FROM s)
SELECT anchor, slot, p.doc_id AS member, round(greatest(0.0, (least(240.0, len) - 30.0)
         * (('0x' || substr(md5('42|' || anchor || '|' || slot || '|' || p.doc_id), 1, 8))::BIGINT / 4294967296::DOUBLE)), 6) AS start_s
FROM a JOIN p USING (source, place)""")
def anchor_groups(spark, sf_dir):
    d = documents(spark, sf_dir).withColumn("len", F.col("n_chars") / 10.0)
    out = splits.anchor_groups(d, "doc_id", "source", 4, length="len", maxlen=240.0, audiolen=30.0)
    return out.withColumn("start_s", F.round("start_s", 6))


@query("shards", """
WITH k AS (SELECT 'u' || doc_id AS uid FROM documents JOIN labels USING (doc_id))
SELECT uid, (row_number() OVER (ORDER BY uid) - 1) // 50 AS shard_id FROM k""")
def shards(spark, sf_dir):
    d = documents(spark, sf_dir).select(F.concat(F.lit("u"), "doc_id").alias("uid"), "n_chars")
    targets = table(spark, sf_dir, "labels").select(F.concat(F.lit("u"), "doc_id").alias("uid"), "quality")
    return writers.plan_shards(d, d, targets, shard_size=50).select("uid", "shard_id")


@query("shuffle_batches", """
SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || doc_id)) AS row_no,
       (row_number() OVER (ORDER BY md5('42|' || doc_id)) - 1) // 128 AS batch_id FROM documents""")
def shuffle_batches(spark, sf_dir):
    return splits.shuffle_batches(documents(spark, sf_dir).select("doc_id"), "doc_id", 128)


@query("batch_slice", """
SELECT doc_id FROM documents QUALIFY (row_number() OVER (ORDER BY md5(doc_id::VARCHAR)) - 1) // 300 = 1""")
def batch_slice(spark, sf_dir):
    d = documents(spark, sf_dir).select("doc_id", F.md5(F.col("doc_id").cast("string")).alias("h"))
    return readers.batch_slice(d, ["h"], 1, 300).select("doc_id")


# ---------------------------------------------------------------- reports

TIMING = """
WITH t AS (SELECT event_type AS stage, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS idx,
                  value AS seconds FROM events)
"""


@query("timing_summary", TIMING + """
SELECT stage, round(avg(seconds), 6) AS mean, round(stddev_pop(seconds), 6) AS std, count(*) AS n
FROM t WHERE idx >= 5 GROUP BY stage""")
def timing_summary(spark, sf_dir):
    idx = F.row_number().over(Window.partitionBy("event_type").orderBy("ts", "event_id")) - 1
    t = table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), idx.alias("idx"), F.col("value").alias("seconds"))
    out = reports.timing_summary(t)
    return out.select("stage", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n")


@query("seeded_sample", "SELECT event_id, value FROM events ORDER BY md5('42|' || event_id), event_id LIMIT 200")
def seeded_sample(spark, sf_dir):
    return reports.seeded_sample(table(spark, sf_dir, "events"), "event_id").select("event_id", "value")


@query("status_counts", "SELECT event_type AS status, count(*) AS n FROM events GROUP BY ALL")
def status_counts(spark, sf_dir):
    return reports.status_counts(table(spark, sf_dir, "events"), "event_type").withColumnRenamed("event_type", "status")


@query("best_epoch", """
WITH log AS (SELECT datediff('day', DATE '2024-01-01', ts::DATE) AS epoch, event_type AS s, avg(value) AS v
             FROM events GROUP BY ALL),
w AS (SELECT DISTINCT epoch FROM log WHERE epoch BETWEEN greatest(0, 20 - 15) AND 20),
n AS (SELECT w.epoch, s, arg_min(v, abs(l.epoch - w.epoch) * 1000 + l.epoch) AS v FROM w JOIN log l
      ON abs(l.epoch - w.epoch) <= 1 GROUP BY ALL)
SELECT epoch, round(avg(v), 6) AS mean FROM n GROUP BY epoch ORDER BY avg(v) DESC, epoch LIMIT 1""")
def best_epoch(spark, sf_dir):
    log = (table(spark, sf_dir, "events")
           .groupBy(F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("epoch"), F.col("event_type").alias("test_set"))
           .agg(F.avg("value").alias("map")))
    return reports.best_epoch(log, 20, 15).withColumn("mean", F.round("mean", 6))


def model_rows(spark, sf_dir, suffixes):
    """One result row an event type and suffix, metrics from the event values."""
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.avg("value").alias("MR1"), (F.avg(F.col("value") / 100)).alias("HR1"),
        F.avg(F.col("value") / 50).alias("HR10"), F.avg(F.col("value") / 80).alias("MAP10"))
    return e.select(F.explode(F.array(*[F.concat(F.col("event_type"), F.lit(s)) for s in suffixes])).alias("model_name"),
                    "MR1", "HR1", "HR10", "MAP10")


MODELS = """
WITH b AS (SELECT event_type AS m, avg(value) AS MR1, avg(value / 100) AS HR1, avg(value / 50) AS HR10, avg(value / 80) AS MAP10
           FROM events GROUP BY ALL),
res AS (SELECT m, m || s AS model_name, s, MR1 * 2 AS MR1, HR1 * 2 AS HR1, HR10 * 2 AS HR10, MAP10 * 2 AS MAP10
        FROM b, (SELECT unnest({0}) AS s)),
cell AS (SELECT r.m, r.model_name, r.s, {1} FROM res r LEFT JOIN b ON b.m = r.m)
"""
CELLS = ", ".join(f"format('{{:.3f}} ({{:.3f}})', r.{m}, r.{m} - b.{m}) AS {m}" for m in ("MR1", "HR1", "HR10", "MAP10"))
SUFFIX = "['+BAAI/bge-m3+mean', '+BAAI/bge-m3+max', '+BM25+mean', '+BM25+max']"


def doubled(df):
    return df.withColumns({m: F.col(m) * 2 for m in reports.METRICS})


@query("report_fused", MODELS.format(SUFFIX, CELLS) + """
SELECT m AS model_name, MR1, HR1, HR10, MAP10, CASE s WHEN '+BAAI/bge-m3+mean' THEN 'BGE Mean'
  WHEN '+BAAI/bge-m3+max' THEN 'BGE Max' WHEN '+BM25+mean' THEN 'BM25 Mean' ELSE 'BM25 Max' END AS type FROM cell""")
def report_fused(spark, sf_dir):
    suffixes = ["+BAAI/bge-m3+mean", "+BAAI/bge-m3+max", "+BM25+mean", "+BM25+max"]
    return reports.report_fused(doubled(model_rows(spark, sf_dir, suffixes)), model_rows(spark, sf_dir, [""]))


@query("report_rerank", MODELS.format("['']", CELLS) + "SELECT model_name, MR1, HR1, HR10, MAP10 FROM cell")
def report_rerank(spark, sf_dir):
    return reports.report_reranked(doubled(model_rows(spark, sf_dir, [""])), model_rows(spark, sf_dir, [""]))


AGAINST = MODELS.split("cell AS")[0] + """
cell AS (SELECT 'target' AS model_name, b.m AS baseline, """ + CELLS + """
         FROM res r JOIN b ON b.m IN ('click', 'error') WHERE r.m = 'view')
SELECT model_name, MR1, HR1, HR10, MAP10{0} FROM cell {1}"""


@query("report_audio", AGAINST.replace("{0}", "['']", 1).replace("{0}", "").replace("{1}", "WHERE baseline = 'click'"))
def report_audio(spark, sf_dir):
    target = doubled(model_rows(spark, sf_dir, [""])).where("model_name = 'view'").withColumn("model_name", F.lit("target"))
    return reports.report_against_one(target, model_rows(spark, sf_dir, [""]), "click", "target")


@query("report_many", AGAINST.replace("{0}", "['']", 1).replace("{0}", ", baseline").replace("{1}", ""))
def report_many(spark, sf_dir):
    target = doubled(model_rows(spark, sf_dir, [""])).where("model_name = 'view'").withColumn("model_name", F.lit("target"))
    return reports.report_against_many(target, model_rows(spark, sf_dir, [""]), ["click", "error"], "target")


# ---------------------------------------------------------------- re-ranking, encoders, evaluation grid

RERANK = DENSE + f""",
t AS (SELECT doc_id AS id, {TOKENS.format('text')} AS k FROM documents),
top AS (SELECT * FROM ranked WHERE rank <= 10),
useful AS (SELECT query_id FROM top WHERE relevant = 1 GROUP BY query_id),
js AS (SELECT p.query_id, p.corpus_id, p.rank AS old_rank, p.relevant,
       round(CASE WHEN len(list_distinct(list_concat(a.k, b.k))) = 0 THEN 0.0
         ELSE len(list_intersect(list_distinct(a.k), list_distinct(b.k))) / len(list_distinct(list_concat(a.k, b.k)))::DOUBLE END, 9) AS score
       FROM top p JOIN useful USING (query_id) JOIN t a ON a.id = p.query_id JOIN t b ON b.id = p.corpus_id),
re AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old_rank))::INT AS new_rank FROM js)
"""


def reranked(spark, sf_dir):
    queries, corpus = dense_inputs(spark, sf_dir)
    ranked = tiles.top_k(queries, corpus, SCORER, 10)
    # tokens once a document instead of once a candidate pair
    texts = spread_small(documents(spark, sf_dir).select(F.col("doc_id").alias("version_id"), "text"), "version_id")
    texts = texts.withColumn("text", F.array_distinct(X.tokens(F.col("text"))))
    return rerank.rerank(rerank.filter_candidates(ranked, corpus), texts, X.jaccard), queries


@query("rerank_topk", RERANK + """
SELECT query_id, corpus_id, round(score, 6) AS score, new_rank AS rank, relevant, old_rank FROM re""")
def rerank_topk(spark, sf_dir):
    return reranked(spark, sf_dir)[0].withColumn("score", F.round("score", 6))


@query("rerank_first", RERANK + """
SELECT query_id, arg_min(corpus_id, new_rank) AS corpus_id, min(new_rank) AS rank, round(arg_min(score, new_rank), 6) AS score
FROM re WHERE relevant = 1 GROUP BY query_id""")
def rerank_first(spark, sf_dir):
    return rerank.first_relevant_in_list(reranked(spark, sf_dir)[0]).withColumn("score", F.round("score", 6))


RERANK_METRICS = RERANK + """,
h AS (SELECT *, sum(relevant) OVER (PARTITION BY query_id ORDER BY new_rank) AS hits FROM re),
per AS (SELECT t.query_id, max(CASE WHEN new_rank = 1 THEN relevant ELSE 0 END) AS h1, max(relevant) AS h10,
               min(CASE WHEN relevant = 1 THEN new_rank END) AS first,
               sum(CASE WHEN relevant = 1 THEN hits / new_rank::DOUBLE ELSE 0 END) / least(10, greatest(1, any_value(t.n_relevant))) AS ap
        FROM h JOIN truth t ON t.query_id = h.query_id GROUP BY t.query_id)
SELECT round(avg(first), 6) AS MR1, round(avg(h1), 6) AS HR1, round(avg(h10), 6) AS HR10, round(avg(h10), 6) AS HR100,
       round(avg(ap), 6) AS MAP10 FROM per"""


@query("rerank_metrics", RERANK_METRICS)
def rerank_metrics(spark, sf_dir):
    again, queries = reranked(spark, sf_dir)
    again = reliable_checkpoint(again)
    out = rerank.rerank_metrics(again, queries.select(F.col("id").alias("query_id"), "n_relevant"))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("encode_hash", """
WITH w AS (SELECT item_id, unnest(string_split(lower(text), ' ')) AS k FROM benchmark),
h AS (SELECT item_id, ('0x' || substr(md5(k), 1, 6))::BIGINT % 16 AS pos,
             CASE WHEN ('0x' || substr(md5(k), 7, 1))::BIGINT < 8 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sign FROM w WHERE k <> ''),
v AS (SELECT item_id, pos, sum(sign) AS x FROM h GROUP BY ALL),
n AS (SELECT item_id, sqrt(sum(x * x)) AS n FROM v GROUP BY item_id)
SELECT b.item_id, p.pos::INT AS pos, round(coalesce(v.x, 0) / n.n, 4) AS value
FROM benchmark b JOIN (SELECT unnest(range(0, 16)) AS pos) p ON true JOIN n USING (item_id)
LEFT JOIN v ON v.item_id = b.item_id AND v.pos = p.pos""")
def encode_hash(spark, sf_dir):
    out = infer.encode_text(table(spark, sf_dir, "benchmark"), "item_id", "text", infer.HashEncoder, "hash16")
    return (out.select("item_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "value"))
            .select("item_id", "pos", (F.round("value", 4) + 0.0).alias("value")))


def _grid_sql():
    scored = DENSE.replace("round(list_inner_product(q.e, c.e) / (q.n * c.n), 9)", "{0}") + METRICS
    select = "SELECT '{1}' AS model_name, round(avg(f.rank), 6) AS MR1, round(avg(h1), 6) AS HR1, round(avg(h10), 6) AS HR10, " \
             "round(avg(h100), 6) AS HR100, round(avg(ap), 6) AS MAP10 FROM per LEFT JOIN firsts f USING (query_id)"
    models = {"cosine": "round(list_inner_product(q.e, c.e) / (q.n * c.n), 9)",
              "sizes": "round(list_inner_product(list_transform(q.e, lambda x: abs(x)), "
                       "list_transform(c.e, lambda x: abs(x))), 9)"}
    return " UNION ALL ".join(f"SELECT * FROM ({(scored + select).replace('{0}', s).replace('{1}', n)})" for n, s in models.items())


@query("eval_grid", _grid_sql())
def eval_grid(spark, sf_dir):
    queries, corpus = dense_inputs(spark, sf_dir)
    def sizes(df):
        return df.withColumn("sizes", F.transform("embedding", F.abs))
    out = evaluate.evaluation_grid({"cosine": (queries, corpus, SCORER),
                                    "sizes": (sizes(queries), sizes(corpus), DenseScorer("sizes", "dotsim"))})
    return out.select("model_name", *[F.round(c, 6).alias(c) for c in out.columns if c != "model_name"])


# ---------------------------------------------------------------- frame arrays

def frames(spark, sf_dir):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("i", F.row_number().over(order))
    return e.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "value"))),
                                                lambda s: s["value"]).alias("frames"))


FRAMES = "WITH f AS (SELECT user_id, list(value ORDER BY ts, event_id) AS fr, count(*) AS n FROM events GROUP BY user_id)"


@query("shingle_frames", FRAMES + """,
s AS (SELECT *, greatest(ceil((n - 20) / 8), 0)::BIGINT AS c FROM f)
SELECT user_id, i::INT AS shingle, least(n - i * 8, 20)::BIGINT AS n_real,
       round(list_sum(fr[i * 8 + 1 : i * 8 + 20]), 4) AS total FROM (SELECT *, unnest(range(0, c + 1)) AS i FROM s)""")
def shingle_frames(spark, sf_dir):
    out = S.shingle_frames(frames(spark, sf_dir), "frames", 20, 8)
    rows = out.select("user_id", F.size("frames").alias("n"), F.posexplode("shingles").alias("shingle", "x"))
    return rows.select("user_id", "shingle", F.least(F.col("n") - F.col("shingle") * 8, F.lit(20)).cast("long").alias("n_real"),
                       F.round(F.aggregate("x", F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


@query("frame_pool", FRAMES + """
SELECT user_id, i::INT AS pool_id, round(list_avg(fr[i * 7 + 1 : i * 7 + 7]), 6) AS mean
FROM (SELECT *, unnest(range(0, n // 7)) AS i FROM f)""")
def frame_pool(spark, sf_dir):
    vectors = frames(spark, sf_dir).withColumn("frames", F.transform("frames", lambda v: F.array(v)))
    return S.pool_frames(vectors, "user_id", "frames", 7).select(
        "user_id", "pool_id", F.round(F.element_at("frame", 1), 6).alias("mean"))


@query("frame_chunk", FRAMES + """
SELECT user_id, round(list_sum(fr[11:90]) - 100.0 * greatest(80 - greatest(n - 10, 0), 0), 4) AS total FROM f""")
def frame_chunk(spark, sf_dir):
    out = S.frame_chunk(frames(spark, sf_dir), "frames", 80, start=10)
    return out.select("user_id", F.round(F.aggregate("chunk", F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


# ---------------------------------------------------------------- small projections and joins

@query("vocal_only", SEG + "SELECT user_id, round(score, 6) AS vocalness_score FROM verdict WHERE score >= 0.5")
def vocal_only(spark, sf_dir):
    verdict = S.accept_tracks(segment_table(spark, sf_dir), "user_id")
    return ids.vocal_only(verdict).select("user_id", F.round("vocalness_score", 6).alias("vocalness_score"))


@query("clean_lines", """
SELECT d.doc_id AS perf, source AS work, quality AS feat, CASE WHEN quality IS NULL THEN md5(text) END AS wav
FROM documents d LEFT JOIN labels USING (doc_id)""")
def clean_lines(spark, sf_dir):
    lines = documents(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left").select(
        F.col("doc_id").alias("perf"), F.col("source").alias("work"), F.col("quality").alias("feat"),
        F.md5("text").alias("wav"), "toxic")
    return ids.clean_lines(lines)


@query("query_prompt", """
SELECT item_id, md5('Instruct: Retrieve semantically similar text.' || chr(10) || 'Query: ' || text) AS prompt FROM benchmark""")
def query_prompt(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.md5(X.query_prompt(F.col("text"))).alias("prompt"))


@query("truncate_duration", "SELECT doc_id, least(n_chars / 10, 240.0)::DOUBLE AS duration FROM documents")
def truncate_duration(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", ids.truncate_duration(F.col("n_chars") / 10).alias("duration"))


@query("in_batches", """
SELECT md5(text) AS md5_encoded, min(doc_id) AS doc_id FROM documents WHERE source IN ('src1', 'src2') GROUP BY ALL""")
def in_batches(spark, sf_dir):
    d = documents(spark, sf_dir).select(F.md5("text").alias("md5_encoded"), "doc_id", F.col("source").alias("batch"))
    return ids.in_batches(d, ["src1", "src2"]).select("md5_encoded", "doc_id")


@query("attach_texts", DENSE + """,
e AS (SELECT f.query_id, r.corpus_id AS fp_id, f.corpus_id AS fn_id
      FROM firsts f LEFT JOIN (SELECT * FROM ranked WHERE rank = 1 AND relevant = 0) r USING (query_id) WHERE f.rank <> 1)
SELECT query_id, fp_id, fn_id, q.n_chars AS q_n_chars, p.n_chars AS fp_n_chars, n.n_chars AS fn_n_chars
FROM e LEFT JOIN documents q ON q.doc_id = query_id LEFT JOIN documents p ON p.doc_id = fp_id
LEFT JOIN documents n ON n.doc_id = fn_id""")
def attach_texts(spark, sf_dir):
    _, _, ranked, first = dense_parts(spark, sf_dir, k=10)
    errors = ranking.error_table(first, ranking.false_positives(ranked)).select("query_id", "fp_id", "fn_id")
    meta = documents(spark, sf_dir).select(F.col("doc_id").alias("version_id"), "n_chars")
    return ids.attach_texts(errors, meta, ["n_chars"])


@query("candidates_in_corpus", DENSE + """
SELECT query_id, corpus_id, rank FROM ranked WHERE rank <= 10 AND corpus_id IN (SELECT doc_id FROM labels)""")
def candidates_in_corpus(spark, sf_dir):
    queries, corpus = dense_inputs(spark, sf_dir)
    ranked = tiles.top_k(queries, corpus, SCORER, 10)
    return ids.candidates_in_corpus(ranked, table(spark, sf_dir, "labels"), "doc_id").select("query_id", "corpus_id", "rank")


@query("relevance_from_pairs", DENSE + """
SELECT query_id, corpus_id, rank, (corpus_id = query_id + 1)::INT AS relevant FROM ranked WHERE rank <= 10""")
def relevance_from_pairs(spark, sf_dir):
    queries, corpus = dense_inputs(spark, sf_dir)
    truth = corpus.select(F.col("id").alias("query_id"), (F.col("id") + 1).alias("corpus_id"))
    ranked = tiles.top_k(queries, corpus, SCORER, 10)
    return ranking.with_relevance(ranked, truth).select("query_id", "corpus_id", "rank", "relevant")


@query("positives_by_query", """
SELECT md5(text) AS query_id, string_agg(DISTINCT doc_id::VARCHAR, ',' ORDER BY doc_id::VARCHAR) AS positives
FROM documents GROUP BY ALL""")
def positives_by_query(spark, sf_dir):
    truth = documents(spark, sf_dir).select(F.md5("text").alias("query_id"), F.col("doc_id").cast("string").alias("corpus_id"))
    return readers.positives_by_query(truth).withColumn("positives", F.array_join("positives", ","))


@query("first_errors", "SELECT event_id, event_type FROM events WHERE event_type <> 'click' ORDER BY event_id LIMIT 10")
def first_errors(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    return reports.first_errors(e, "event_id", "event_type", "click")


# ---------------------------------------------------------------- evaluation methods over documents, work = source

def by_text(spark, sf_dir):
    return documents(spark, sf_dir).select(
        F.col("doc_id").alias("version_id"), F.col("source").alias("clique_id"), "text")


def rounded(df):
    return df.select(*[F.round(c, 6).alias(c) for c in df.columns])


@query("evaluate_bm25", f"""
WITH d AS (SELECT doc_id AS id, source AS label, text FROM documents),
tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({TOKENS.format('text')}) AS term FROM d) GROUP BY ALL),
n AS (SELECT count(*)::DOUBLE AS n FROM d), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
dl AS (SELECT d.id, coalesce(sum(tf), 0)::DOUBLE AS dl FROM d LEFT JOIN tf USING (id) GROUP BY d.id),
bm AS (SELECT tf.id, tf.term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf
         / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM dl))) AS w
       FROM tf JOIN df USING (term) JOIN dl ON dl.id = tf.id, n),
s AS (SELECT q.id AS a, c.id AS b, sum(q.tf * c.w) AS s FROM tf q JOIN bm c USING (term) GROUP BY ALL),
pairs AS (SELECT q.id AS query_id, c.id AS corpus_id, (q.label = c.label)::INT AS relevant, round(coalesce(s, 0.0), 9) AS score
          FROM d q JOIN d c ON q.id <> c.id LEFT JOIN s ON a = q.id AND b = c.id),
truth AS (SELECT id AS query_id, count(*) OVER (PARTITION BY label) - 1 AS n_relevant FROM d
          QUALIFY count(*) OVER (PARTITION BY label) > 1),
ranked AS (SELECT p.*, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, corpus_id))::INT AS rank
           FROM pairs p SEMI JOIN truth USING (query_id)),
firsts AS (SELECT query_id, min(rank) AS rank FROM ranked WHERE relevant = 1 GROUP BY query_id)""" + METRICS + """
SELECT round(avg(f.rank), 6) AS MR1, round(avg(h1), 6) AS HR1, round(avg(h10), 6) AS HR10,
       round(avg(h100), 6) AS HR100, round(avg(ap), 6) AS MAP10 FROM per LEFT JOIN firsts f USING (query_id)""")
def evaluate_bm25(spark, sf_dir):
    return rounded(evaluate.evaluate("bm25", by_text(spark, sf_dir), texts="text").metrics)


def chunk_recordings(spark, sf_dir):
    items = vectors.stacked(spark, sf_dir)
    return items.select(F.col("id").alias("version_id"), F.col("label").alias("clique_id")), items


CHUNK_METRICS = vectors.CHUNKS + """,
m AS (SELECT query_id, corpus_id, s1, max(sim) AS s FROM cp GROUP BY ALL),
sc AS (SELECT query_id, corpus_id, round(avg(s), 9) AS score FROM m GROUP BY ALL),
truth AS (SELECT id AS query_id, count(*) OVER (PARTITION BY label) - 1 AS n_relevant FROM lab
          QUALIFY count(*) OVER (PARTITION BY label) > 1),
ranked AS (SELECT sc.*, (a.label = b.label)::INT AS relevant,
                  (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, corpus_id))::INT AS rank
           FROM sc JOIN lab a ON a.id = query_id JOIN lab b ON b.id = corpus_id SEMI JOIN truth USING (query_id)),
firsts AS (SELECT query_id, min(rank) AS rank FROM ranked WHERE relevant = 1 GROUP BY query_id)""" + METRICS + """
SELECT round(avg(f.rank), 6) AS MR1, round(avg(h1), 6) AS HR1, round(avg(h10), 6) AS HR10,
       round(avg(h100), 6) AS HR100, round(avg(ap), 6) AS MAP10 FROM per LEFT JOIN firsts f USING (query_id)"""


@query("evaluate_chunked", CHUNK_METRICS)
def evaluate_chunked(spark, sf_dir):
    recs, items = chunk_recordings(spark, sf_dir)
    return rounded(evaluate.evaluate("chunked", recs, embeddings=items.select("id", "vectors")).metrics)


def word_vectors(spark, sf_dir):
    return lexical.tfidf(documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "text"))


SPARSE_SQL = f"""
WITH d AS (SELECT doc_id AS id, source AS label, text FROM documents),
tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({TOKENS.format('text')}) AS term FROM d) GROUP BY ALL),
n AS (SELECT count(*)::DOUBLE AS n FROM d), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS (SELECT id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term), n),
vec AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM raw),
s AS (SELECT q.id AS a, c.id AS b, sum(q.w * c.w) AS s FROM vec q JOIN vec c USING (term) GROUP BY ALL),
pairs AS (SELECT q.id AS query_id, c.id AS corpus_id, (q.label = c.label)::INT AS relevant, round(coalesce(s, 0.0), 9) AS score
          FROM d q JOIN d c ON q.id <> c.id LEFT JOIN s ON a = q.id AND b = c.id),
truth AS (SELECT id AS query_id, count(*) OVER (PARTITION BY label) - 1 AS n_relevant FROM d
          QUALIFY count(*) OVER (PARTITION BY label) > 1),
ranked AS (SELECT p.*, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, corpus_id))::INT AS rank
           FROM pairs p SEMI JOIN truth USING (query_id)),
firsts AS (SELECT query_id, min(rank) AS rank FROM ranked WHERE relevant = 1 GROUP BY query_id)""" + METRICS + """
SELECT round(avg(f.rank), 6) AS MR1, round(avg(h1), 6) AS HR1, round(avg(h10), 6) AS HR10,
       round(avg(h100), 6) AS HR100, round(avg(ap), 6) AS MAP10 FROM per LEFT JOIN firsts f USING (query_id)"""


@query("evaluate_sparse", SPARSE_SQL)
def evaluate_sparse(spark, sf_dir):
    return rounded(evaluate.evaluate("sparse", by_text(spark, sf_dir), embeddings=word_vectors(spark, sf_dir)).metrics)


# the sparse scores of SPARSE_SQL, signed hashing of words into 16 places, and the mean of both softmaxes over all others
FUSION_SQL = SPARSE_SQL.replace("""pairs AS (SELECT q.id AS query_id, c.id AS corpus_id, (q.label = c.label)::INT AS relevant, round(coalesce(s, 0.0), 9) AS score
          FROM d q JOIN d c ON q.id <> c.id LEFT JOIN s ON a = q.id AND b = c.id),""", """words AS (
  SELECT id, md5(word) AS h FROM (SELECT id, unnest(string_split(lower(text), ' ')) AS word FROM d) WHERE word <> ''),
places AS (SELECT id, ('0x' || substr(h, 1, 6))::BIGINT % 16 AS place,
                  sum(CASE WHEN substr(h, 7, 1) < '8' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS v FROM words GROUP BY ALL),
unit AS (SELECT id, place, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS v FROM places QUALIFY sum(v * v) OVER (PARTITION BY id) > 0),
e AS (SELECT q.id AS a, c.id AS b, sum(q.v * c.v) AS e FROM unit q JOIN unit c USING (place) WHERE q.id <> c.id GROUP BY ALL),
both_scores AS (SELECT q.id AS query_id, c.id AS corpus_id, (q.label = c.label)::INT AS relevant, coalesce(s, 0.0) AS s,
                       coalesce(e, 0.0) AS e
                FROM d q JOIN d c ON q.id <> c.id LEFT JOIN s ON s.a = q.id AND s.b = c.id LEFT JOIN e ON e.a = q.id AND e.b = c.id),
tops AS (SELECT query_id, max(s) AS ms, max(e) AS me FROM both_scores GROUP BY query_id),
sums AS (SELECT query_id, sum(exp(s - ms)) AS ss, sum(exp(e - me)) AS se FROM both_scores JOIN tops USING (query_id) GROUP BY query_id),
pairs AS (SELECT query_id, corpus_id, relevant, round((exp(s - ms) / ss + exp(e - me) / se) / 2, 9) AS score
          FROM both_scores JOIN tops USING (query_id) JOIN sums USING (query_id)),""")


@query("evaluate_fusion", FUSION_SQL)
def evaluate_fusion(spark, sf_dir):
    meta = by_text(spark, sf_dir)
    dense = infer.encode_text(documents(spark, sf_dir), "doc_id", "text", infer.HashEncoder, "hash16").select(
        F.col("doc_id").alias("id"), "embedding")
    return rounded(evaluate.evaluate("fusion", meta, embeddings=dense, second=word_vectors(spark, sf_dir)).metrics)


@query("encode_text_chunks")
def encode_text_chunks(spark, sf_dir):
    out = infer.encode_text(documents(spark, sf_dir), "doc_id", "text", infer.HashEncoder, "hash16", chunked=True)
    return out.select("doc_id", "chunk_id", F.size("embedding").alias("width"), "status")
