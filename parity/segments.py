"""Segment queries over `events`: 3-second segments of a user's events, vocalness from the value."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from parity.registry import query, table
from versionlake.operators import segments as S

SEG = """
WITH seg AS (
  SELECT user_id, 3.0::DOUBLE * (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) AS start,
         least(value / 70, 1.0) AS vocalness FROM events),
s AS (SELECT user_id, start, start + 3.0 AS "end", vocalness FROM seg),
vocal AS (SELECT *, lag("end") OVER (PARTITION BY user_id ORDER BY start) AS pe FROM s WHERE vocalness > 0.5),
isl AS (SELECT *, sum(CASE WHEN pe = start THEN 0 ELSE 1 END)
          OVER (PARTITION BY user_id ORDER BY start ROWS UNBOUNDED PRECEDING) AS g FROM vocal),
merged AS (
  SELECT user_id, min(start) AS start, max("end") AS "end",
         list_reduce(list(vocalness ORDER BY start), lambda a, b: (a + b) / 2) AS vocalness
  FROM isl GROUP BY user_id, g),
verdict AS (SELECT user_id, avg(vocalness) AS score FROM s GROUP BY user_id)
"""

PAD = """,
padded AS (
  SELECT user_id, greatest(0.0, start - p) AS start, "end" + p AS "end"
  FROM (SELECT *, CASE WHEN "end" - start < 30 THEN least({limit}, (30 - ("end" - start)) / 2) ELSE 0.0 END AS p
        FROM {source})),
w1 AS (SELECT *, max("end") OVER (PARTITION BY user_id ORDER BY start, "end"
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM padded),
w2 AS (SELECT *, sum(CASE WHEN pm IS NULL OR start > pm THEN 1 ELSE 0 END)
         OVER (PARTITION BY user_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS g FROM w1),
win AS (SELECT user_id, min(start) AS start, max("end") AS "end" FROM w2 GROUP BY user_id, g),
sliced AS (
  SELECT user_id, start + i * 30.0 AS start, least("end", start + i * 30.0 + 30.0) AS "end"
  FROM (SELECT *, unnest(range(0, ceil(("end" - start) / 30)::BIGINT)) AS i FROM win))
"""


def segment_table(spark, sf_dir):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    start = F.lit(3.0) * (F.row_number().over(order) - 1)
    return (table(spark, sf_dir, "events")
            .select("user_id", start.alias("start"), F.least(F.col("value") / 70, F.lit(1.0)).alias("vocalness"))
            .withColumn("end", F.col("start") + 3.0))


def rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("segment_merge", SEG + """
SELECT user_id, start, "end", round(vocalness, 6) AS vocalness FROM merged""")
def segment_merge(spark, sf_dir):
    return rounded(S.merge_vocal(segment_table(spark, sf_dir), "user_id"), "vocalness")


@query("vocal_accept", SEG + """
SELECT user_id, round(score, 6) AS vocalness_score, score >= 0.5 AS is_vocal FROM verdict""")
def vocal_accept(spark, sf_dir):
    return rounded(S.accept_tracks(segment_table(spark, sf_dir), "user_id"), "vocalness_score")


@query("instrumental_flags", SEG + """
SELECT user_id, bool_and(vocalness <= 0.5) AS all_instrumental, avg(vocalness) < 0.2 AS is_instrumental,
       round(avg((vocalness <= 0.5)::INT), 6) AS per_instrumental_segments FROM s GROUP BY user_id""")
def instrumental_flags(spark, sf_dir):
    return rounded(S.instrumental_flags(segment_table(spark, sf_dir), "user_id"), "per_instrumental_segments")


@query("pad_merge_slice", SEG + PAD.format(limit="10.0", source="merged") + """
SELECT user_id, round(start, 6) AS start, round("end", 6) AS "end" FROM sliced""")
def pad_merge_slice(spark, sf_dir):
    merged = S.merge_vocal(segment_table(spark, sf_dir), "user_id")
    return rounded(S.pad_merge_slice(merged, "user_id"), "start", "end")


@query("pad_merge_slice_half", SEG + PAD.format(limit="5.0", source="merged") + """
SELECT user_id, round(start, 6) AS start, round("end", 6) AS "end" FROM sliced""")
def pad_merge_slice_half(spark, sf_dir):
    merged = S.merge_vocal(segment_table(spark, sf_dir), "user_id")
    return rounded(S.pad_merge_slice(merged, "user_id", pad_mode="half"), "start", "end")


RECORD = """,
accepted AS (SELECT m.* FROM merged m JOIN verdict v USING (user_id) WHERE v.score >= 0.5)
"""


def as_text(column, *fields):
    return F.expr(f"array_join(transform({column}, x -> "
                  + "concat_ws(':', " + ", ".join(f"format_string('%.3f', x.{f})" for f in fields) + ")), ',')")


@query("detection_record", SEG + RECORD + PAD.format(limit="10.0", source="accepted") + """,
names AS (SELECT DISTINCT user_id FROM events),
m AS (SELECT user_id, string_agg(format('{:.3f}:{:.3f}', start, "end"), ',' ORDER BY start) AS segs,
             count(*) AS n FROM merged GROUP BY user_id),
k AS (SELECT user_id, string_agg(format('{:.3f}:{:.3f}', start, "end"), ',' ORDER BY start) AS chunks,
             count(*) AS n FROM sliced GROUP BY user_id)
SELECT user_id, 'V-' || user_id AS version_id, score >= 0.5 AS is_vocal, round(score, 6) AS vocalness_score,
       coalesce(segs, '') AS res_detection, coalesce(chunks, '') AS chunks_sec,
       coalesce(m.n, 0)::INT AS nb_vocal_segments, coalesce(k.n, 0)::INT AS nb_audio_chunks
FROM names JOIN verdict USING (user_id) LEFT JOIN m USING (user_id) LEFT JOIN k USING (user_id)""")
def detection_record(spark, sf_dir):
    names = (table(spark, sf_dir, "events").select("user_id").distinct()
             .withColumn("version_id", F.concat(F.lit("V-"), F.col("user_id").cast("string"))))
    out = S.count_columns(S.detection_record(segment_table(spark, sf_dir), names, "user_id"))
    return rounded(out.withColumns({"res_detection": as_text("res_detection", "start", "end"),
                                    "chunks_sec": as_text("chunks_sec", "start", "end")}), "vocalness_score")


@query("detect_only", SEG + """,
m AS (SELECT user_id, count(*) AS n, sum("end" - start) AS seconds FROM merged GROUP BY user_id)
SELECT user_id, score >= 0.5 AS is_vocal, round(score, 6) AS vocalness_score,
       coalesce(n, 0)::INT AS n_segments, round(coalesce(seconds, 0), 6) AS seconds
FROM verdict LEFT JOIN m USING (user_id)""")
def detect_only(spark, sf_dir):
    out = S.detect_only(segment_table(spark, sf_dir), "user_id")
    seconds = F.aggregate("res_detection", F.lit(0.0), lambda a, s: a + s["end"] - s["start"])
    return rounded(out.select("user_id", "is_vocal", "vocalness_score", F.size("res_detection").alias("n_segments"),
                              seconds.alias("seconds")), "vocalness_score", "seconds")


DURATIONS = "WITH d AS (SELECT user_id, sum(value) / 10 AS duration FROM events GROUP BY user_id)"


def durations(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg((F.sum("value") / 10).alias("duration"))


@query("fixed_grid", DURATIONS + """
SELECT user_id, i::INT AS chunk_id, i * 30.0::DOUBLE AS start, round(least(duration, i * 30.0 + 30.0), 6) AS "end",
       round(30.0 - (least(duration, i * 30.0 + 30.0) - i * 30.0), 6) AS pad
FROM (SELECT *, unnest(range(0, ceil(duration / 30)::BIGINT)) AS i FROM d WHERE duration > 0)""")
def fixed_grid(spark, sf_dir):
    return rounded(S.fixed_grid(durations(spark, sf_dir)), "end", "pad").drop("duration")


@query("sample_plan", SEG + """,
p AS (SELECT user_id, start, "end", round_even((start + 0.123) * 16000, 0)::BIGINT AS start_sample,
             round_even(("end" + 0.123) * 16000, 0)::BIGINT AS end_sample FROM merged)
SELECT user_id, start, "end", start_sample, end_sample,
       greatest(480000 - (end_sample - start_sample), 0)::BIGINT AS pad,
       greatest(end_sample - start_sample - 480000, 0)::BIGINT AS cut FROM p""")
def sample_plan(spark, sf_dir):
    merged = S.merge_vocal(segment_table(spark, sf_dir), "user_id").drop("vocalness")
    moved = merged.withColumns({"start": F.col("start") + 0.123, "end": F.col("end") + 0.123})
    return S.sample_plan(moved, 16000).withColumns(
        {"start": F.round(F.col("start") - 0.123, 6), "end": F.round(F.col("end") - 0.123, 6)})


@query("fixed_windows", DURATIONS + """
SELECT user_id::VARCHAR || '-▁start-' || (i * 15)::BIGINT AS perf, i * 15.0::DOUBLE AS start_s, (i * 375)::INT AS start
FROM (SELECT *, unnest(range(0, greatest(ceil((duration - 15) / 15), 1)::BIGINT)) AS i FROM d)
WHERE i = 0 OR i * 15.0 + 15 < duration""")
def fixed_windows(spark, sf_dir):
    perfs = durations(spark, sf_dir).select(F.col("user_id").cast("string").alias("perf"),
                                            F.col("duration").alias("dur_s"))
    return S.fixed_windows(perfs, 15.0, 15.0).select("perf", "start_s", "start")


@query("align_chunks", SEG + """,
piece AS (SELECT conv_id AS k, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos,
                 count(*) OVER (PARTITION BY conv_id) AS n
          FROM conversations WHERE length(trim(text)) > 0),
sized AS (SELECT m.user_id, m.start, m."end", p.n,
                 row_number() OVER (PARTITION BY m.user_id ORDER BY m."end" - m.start DESC, m.start) AS r
          FROM merged m JOIN (SELECT DISTINCT k, n FROM piece) p ON p.k = m.user_id),
kept AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start) - 1 AS chunk_id FROM sized WHERE r <= n)
SELECT user_id, chunk_id::INT AS chunk_id, start, "end", "end" - start AS duration, md5(text) AS transcription
FROM kept JOIN piece ON k = user_id AND pos = chunk_id""")
def align_chunks(spark, sf_dir):
    merged = S.merge_vocal(segment_table(spark, sf_dir), "user_id")
    turns = table(spark, sf_dir, "conversations").where(F.length(F.trim("text")) > 0)
    pieces = turns.groupBy(F.col("conv_id").alias("user_id")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda s: s["text"]).alias("pieces"))
    return (S.align_pieces(merged, pieces, "user_id")
            .withColumn("transcription", F.md5("transcription")))
