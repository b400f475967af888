"""Whole flows: files written and read back, evaluation and re-ranking runs, training chunks, streams."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

from parity import tables, vectors
from parity.registry import query, table
from parity.retrieval import DENSE, METRICS, SCORER, recordings
from parity.segments import PAD, SEG, segment_table
from versionlake.operators import infer, ranking, segments as S, tiles
from versionlake.plans import datasets, evaluate
from versionlake.session import shared_folder
from versionlake.sources import readers, writers
from versionlake.streaming.ranking import rank_arrivals
from versionlake.streaming.segments import merge_vocal_stream

# ---------------------------------------------------------------- files, written and read back


@query("metadata_file", """
SELECT doc_id::VARCHAR AS version_id, source AS clique_id, md5(text) AS text, n_chars::DOUBLE AS n_chars FROM documents""")
def metadata_file(spark, sf_dir):
    path = shared_folder(spark, "metadata")
    writers.write_csv(table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("version_id"), F.col("source").alias("clique_id"), "text", "n_chars"), path)
    back = readers.read_metadata(spark, path, {
        "version_id": "string", "clique_id": "string", "text": "string", "n_chars": "double"}, ["version_id", "text"])
    return back.withColumn("text", F.md5("text"))


@query("lenient_csv", "SELECT doc_id, source, n_chars::BIGINT AS n_chars FROM documents WHERE lang <> 'fr'")
def lenient_csv(spark, sf_dir):
    """Lines of French documents get a field too many."""
    path = shared_folder(spark, "lenient")
    more = F.when(F.col("lang") == "fr", F.lit("fr"))
    lines = table(spark, sf_dir, "documents").select(
        F.concat_ws(",", "doc_id", "source", "n_chars", more).alias("doc_id,source,n_chars"))
    # no quoting and a separator that no line holds: the column goes out as it is, under its own name as header
    lines.write.option("header", True).option("sep", "\u0001").option("quote", "\u0000").csv(path)
    return readers.read_lenient_csv(spark, path, {"doc_id": "bigint", "source": "string", "n_chars": "bigint"})


@query("embedding_files", """
SELECT (vec_id // 5)::VARCHAR AS id, (vec_id % 5)::INT AS chunk_id, len(embedding)::INT AS width,
       round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings""")
def embedding_files(spark, sf_dir):
    path = shared_folder(spark, "embeddings")
    writers.write_embeddings(vectors.chunks(spark, sf_dir).select(
        F.col("id").cast("string").alias("id"), "chunk_id", F.col("embedding").cast("array<float>").alias("embedding")), path)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return readers.read_embeddings(spark, path).select(
        "id", "chunk_id", F.size("embedding").alias("width"), F.round(total, 6).alias("total"))


@query("line_files", """
SELECT doc_id::VARCHAR AS perf, source AS work, n_chars / 10.0::DOUBLE AS dur_s, NULL::VARCHAR AS feat FROM documents""")
def line_files(spark, sf_dir):
    path = shared_folder(spark, "lines")
    writers.write_lines(table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("perf"), F.col("source").alias("work"), (F.col("n_chars") / 10.0).alias("dur_s")), path)
    return readers.read_lines(spark, path, {"perf": "string", "work": "string", "dur_s": "double", "feat": "string"})


@query("id_files", "SELECT event_id::VARCHAR AS id FROM events WHERE event_type = 'error'")
def id_files(spark, sf_dir):
    path = shared_folder(spark, "ids")
    writers.write_ids(table(spark, sf_dir, "events").where("event_type = 'error'"), "event_id", path)
    return readers.read_ids(readers.read_plain(spark, path, "txt"), "value")


@query("truth_files", """
SELECT a.doc_id::VARCHAR AS query_id, string_agg(b.doc_id::VARCHAR, ',' ORDER BY b.doc_id::VARCHAR) AS positives
FROM documents a JOIN documents b ON b.doc_id IN (a.doc_id + 1, a.doc_id + 2) GROUP BY a.doc_id""")
def truth_files(spark, sf_dir):
    path = shared_folder(spark, "truth")
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("corpus_id"))
    near = ids.select("corpus_id", F.explode(F.array(F.col("corpus_id") - 1, F.col("corpus_id") - 2)).alias("query_id"))
    writers.write_csv(near.join(ids.select(F.col("corpus_id").alias("query_id")), "query_id", "left_semi")
                      .select("query_id", "corpus_id"), path)
    truth = readers.positives_by_query(readers.read_truth(spark, path))
    return truth.withColumn("positives", F.array_join("positives", ","))


@query("shard_files", """
WITH k AS (SELECT 'u' || doc_id AS uid, quality FROM documents JOIN labels USING (doc_id)),
s AS (SELECT *, ((row_number() OVER (ORDER BY uid) - 1) // 50)::INT AS shard_id FROM k)
SELECT uid, quality, shard_id, substr(uid, 1, 3) || '/' || uid AS path, row_number() OVER (ORDER BY md5('42|' || uid)) AS row_no,
       (row_number() OVER (ORDER BY md5('42|' || uid)) - 1) // 16 AS batch_id FROM s""")
def shard_files(spark, sf_dir):
    path = shared_folder(spark, "shards")
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("u"), "doc_id").alias("uid"))
    targets = table(spark, sf_dir, "labels").select(F.concat(F.lit("u"), "doc_id").alias("uid"), "quality")
    writers.write_shards(d, d, targets, path, shard_size=50)
    return readers.read_shards(spark, path, batch_size=16).select(
        "uid", "quality", F.col("shard_id").cast("int").alias("shard_id"), "path", "row_no", "batch_id")


# ---------------------------------------------------------------- runs

METRIC_ROW = """
SELECT round(avg(f.rank), 6) AS MR1, round(avg(h1), 6) AS HR1, round(avg(h10), 6) AS HR10,
       round(avg(h100), 6) AS HR100, round(avg(ap), 6) AS MAP10 FROM per LEFT JOIN firsts f USING (query_id)"""


@query("evaluate_dense", DENSE + METRICS + METRIC_ROW)
def evaluate_dense(spark, sf_dir):
    meta, embeddings = recordings(spark, sf_dir)
    return tables.rounded(evaluate.evaluate("dense", meta, embeddings=embeddings).metrics)


CHUNK_RANKS = """,
truth AS (SELECT id AS query_id, count(*) OVER (PARTITION BY label) - 1 AS n_relevant FROM lab
          QUALIFY count(*) OVER (PARTITION BY label) > 1),
ranked AS (SELECT query_id, corpus_id, (a.label = b.label)::INT AS relevant,
                  (row_number() OVER (PARTITION BY query_id ORDER BY s DESC, corpus_id))::INT AS rank
           FROM sc JOIN lab a ON a.id = query_id JOIN lab b ON b.id = corpus_id SEMI JOIN truth USING (query_id)),
firsts AS (SELECT query_id, min(rank) AS rank FROM ranked WHERE relevant = 1 GROUP BY query_id)"""


@query("evaluate_bge", vectors.HYBRID.removesuffix(vectors.RANKED.format("s")) + CHUNK_RANKS + METRICS + METRIC_ROW)
def evaluate_bge(spark, sf_dir):
    items = vectors.hybrid_items(spark, sf_dir)
    meta = items.select(F.col("id").alias("version_id"), F.col("label").alias("clique_id"))
    return tables.rounded(evaluate.evaluate("bge", meta, embeddings=items.drop("label")).metrics)


class WordOverlap:
    """Pair model for tests: shared distinct words of two texts over all of them."""

    word = re.compile(r"\b\w\w+\b")

    def __call__(self, pairs: list[tuple[str, str]]) -> list[float]:
        sets = [[set(self.word.findall(text.lower())) for text in pair] for pair in pairs]
        return [len(a & b) / len(a | b) if a | b else 0.0 for a, b in sets]


@query("rerank_run", tables.RERANK_METRICS)
def rerank_run(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("version_id"), "text")
    meta = recordings(spark, sf_dir)[0].join(texts, "version_id", "left")
    queries, corpus = tables.dense_inputs(spark, sf_dir)
    ranked = tiles.top_k(queries, corpus, SCORER, 10)
    run = evaluate.rerank_run(ranked, meta, infer.pandas_scorer(WordOverlap, "word-overlap"), "text")
    return tables.rounded(run.metrics)


@query("topk_with_gaps", DENSE.replace("FROM embeddings),", "FROM embeddings WHERE embedding[1] < 0.1),", 1) + """
SELECT query_id, corpus_id, round(score, 6) AS score, rank, relevant FROM ranked WHERE rank <= 10""")
def topk_with_gaps(spark, sf_dir):
    """Records without a vector take no part, neither as a query nor as a candidate."""
    meta, embeddings = recordings(spark, sf_dir)
    none = F.array().cast(embeddings.schema["embedding"].dataType)
    gaps = embeddings.withColumn("embedding", F.when(F.element_at("embedding", 1) < 0.1, F.col("embedding")).otherwise(none))
    queries, corpus = ranking.evaluation_set(meta, gaps)
    return ranking.rank_results(queries, corpus, SCORER, 10).withColumn("score", F.round("score", 6))


class PickyEncoder:
    """Encoder for tests that refuses texts of some lengths, alone or in a batch."""

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if any(len(t) % 7 == 0 for t in texts):
            raise ValueError("unusable text")
        return [np.array([len(t)]) for t in texts]


@query("encoder_failures", """
SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 'empty' WHEN length(text) % 7 = 0 THEN 'failed' ELSE 'ok' END AS status,
       CASE WHEN coalesce(text, '') <> '' AND length(text) % 7 <> 0 THEN length(text) END AS value FROM documents""")
def encoder_failures(spark, sf_dir):
    out = infer.encode_text(table(spark, sf_dir, "documents"), "doc_id", "text", PickyEncoder, "picky")
    return out.select("doc_id", "status", F.get("embedding", 0).cast("bigint").alias("value"))


@query("training_chunks", SEG + PAD.format(limit="5.0", source="merged") + """,
talk AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS t FROM conversations GROUP BY conv_id),
piece AS (SELECT conv_id, unnest(p) AS text, unnest(range(0, len(p))) AS pos, len(p) AS n FROM (
            SELECT conv_id, list_filter(string_split(t, chr(10) || chr(10)), lambda x: regexp_matches(x, '\\S')) AS p FROM talk)),
sized AS (SELECT s.user_id, s.start, s."end", p.n,
                 row_number() OVER (PARTITION BY s.user_id ORDER BY s."end" - s.start DESC, s.start) AS r
          FROM sliced s JOIN (SELECT DISTINCT conv_id, n FROM piece) p ON p.conv_id = s.user_id),
kept AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start) - 1 AS chunk_id FROM sized WHERE r <= n)
SELECT user_id AS version_id, user_id % 9 AS clique_id, chunk_id::INT AS chunk_id, round(start, 6) AS start,
       round("end" - start, 6) AS duration, round(score, 6) AS vocalness, user_id * 2 AS deezer_id, md5(text) AS transcription
FROM kept JOIN piece ON conv_id = user_id AND pos = chunk_id JOIN verdict USING (user_id)""")
def training_chunks(spark, sf_dir):
    segments = segment_table(spark, sf_dir)
    found = S.detect_only(segments, "user_id").select(
        F.col("user_id").alias("md5_encoded"), F.col("res_detection").alias("segments"), "vocalness_score")
    talks = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("md5_encoded")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]),
                     "\n\n").alias("transcription"))
    user = F.col("user_id")
    meta = segments.select("user_id").distinct().select(
        user.alias("version_id"), (user % 9).alias("clique_id"), user.alias("md5_encoded"), (user * 2).alias("deezer_id"))
    out = datasets.training_chunks(meta, talks, found)
    return out.select("version_id", "clique_id", "chunk_id", F.round("start", 6).alias("start"),
                      F.round("duration", 6).alias("duration"), F.round("vocalness", 6).alias("vocalness"), "deezer_id",
                      F.md5("transcription").alias("transcription"))


# ---------------------------------------------------------------- streams

@query("stream_arrivals", DENSE + """
SELECT query_id, corpus_id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 10""")
def stream_arrivals(spark, sf_dir):
    corpus = vectors.labelled(spark, sf_dir)
    path = shared_folder(spark, "arrivals")
    corpus.write.parquet(f"{path}/in")
    arrivals = spark.readStream.schema(corpus.schema).parquet(f"{path}/in")
    rank_arrivals(arrivals, corpus, SCORER, f"{path}/out", f"{path}/state", k=10).awaitTermination()
    return spark.read.parquet(f"{path}/out").select("query_id", "corpus_id", F.round("score", 6).alias("score"), "rank")


@query("stream_segments", SEG + """
SELECT user_id, start, "end", round(vocalness, 6) AS vocalness FROM merged""")
def stream_segments(spark, sf_dir):
    """Segments arrive as files; a last segment of no user, far ahead in time, moves the watermark behind all others."""
    path = shared_folder(spark, "segments")
    rows = segment_table(spark, sf_dir).select("user_id", "start", "end", "vocalness")

    def arrive():
        merged = merge_vocal_stream(spark.readStream.schema(rows.schema).parquet(f"{path}/in"), "user_id")
        (merged.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state")
         .outputMode("append").trigger(availableNow=True).start().awaitTermination())

    rows.write.parquet(f"{path}/in")
    arrive()
    last = rows.agg(F.max("end").alias("at"))
    last.select(F.lit(-1).cast(rows.schema["user_id"].dataType).alias("user_id"), (F.col("at") + 10_000).alias("start"),
                (F.col("at") + 10_003).alias("end"), F.lit(1.0).alias("vocalness")).write.mode("append").parquet(f"{path}/in")
    arrive()
    return spark.read.parquet(f"{path}/out").where("user_id <> -1").withColumn("vocalness", F.round("vocalness", 6))
