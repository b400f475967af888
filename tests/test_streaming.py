import numpy as np
from pyspark.sql import functions as F

from versionlake.functions.scorers import DenseScorer
from versionlake.operators import segments as S, tiles
from versionlake.streaming.ranking import rank_arrivals
from versionlake.streaming.segments import merge_vocal_stream


def test_arrivals_are_ranked_once(spark, tmp_path):
    rng = np.random.default_rng(1)
    corpus = spark.createDataFrame([(f"c{i}", "x", [float(v) for v in rng.normal(size=4)]) for i in range(12)],
                                   "id string, label string, embedding array<double>")
    arrivals = str(tmp_path / "in")
    for n in range(2):
        corpus.where(F.col("id").isin(f"c{n}", f"c{n + 5}")).write.mode("append").parquet(arrivals)
        stream = spark.readStream.schema(corpus.schema).parquet(arrivals)
        rank_arrivals(stream, corpus, DenseScorer(), str(tmp_path / "out"), str(tmp_path / "cp"), k=3).awaitTermination()
    got = sorted((r["query_id"], r["rank"], r["corpus_id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    batch = tiles.top_k(corpus.where("id in ('c0', 'c1', 'c5', 'c6')"), corpus, DenseScorer(), 3)
    assert got == sorted((r["query_id"], r["rank"], r["corpus_id"]) for r in batch.collect())


def test_stream_merge_equals_batch(spark, tmp_path):
    rows = [(k, 3.0 * i, 3.0 * i + 3.0, 0.9 if (i * 7 + len(k)) % 5 else 0.1) for k in ("a", "bb") for i in range(40)]
    df = spark.createDataFrame(rows, "md5_encoded string, start double, end double, vocalness double")
    late = spark.createDataFrame([("z", 90000.0, 90003.0, 0.9), ], df.schema)
    path = str(tmp_path / "in")
    df.where("start < 60").repartition(1).write.mode("append").parquet(path)
    out = merge_vocal_stream(spark.readStream.schema(df.schema).parquet(path), delay="30 seconds")
    q = out.writeStream.format("memory").queryName("merged").outputMode("append").option(
        "checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    for part in (df.where("start >= 60"), late, late.withColumn("start", F.col("start") + 500).withColumn("end", F.col("end") + 500)):
        part.repartition(1).write.mode("append").parquet(path)
        q.processAllAvailable()
    q.stop()
    got = sorted((r["md5_encoded"], r["start"], r["end"], round(r["vocalness"], 9)) for r in spark.table("merged").where("md5_encoded <> 'z'").collect())
    want = sorted((r["md5_encoded"], r["start"], r["end"], round(r["vocalness"], 9)) for r in S.merge_vocal(df).collect())
    assert got == want


def test_stream_merge_drops_late_rows_and_holds_a_large_key(spark, tmp_path):
    n = 200_000
    big = (spark.range(n).select(
        F.lit(7).cast("bigint").alias("k"), (F.col("id") * 3.0).alias("start"), (F.col("id") * 3.0 + 3.0).alias("end"),
        F.when(F.col("id") % 1000 == 999, 0.1).otherwise(0.6 + (F.col("id") % 7) / 20).alias("vocalness")))
    rows = "k bigint, start double, end double, vocalness double"
    # rows without a key or an end take no part
    odd = spark.createDataFrame([(None, 0.0, 3.0, 0.9), (None, 3.0, 6.0, 0.7), (7, 1.0, None, 0.9), (8, 9.0, 12.0, 0.4)], rows)
    marker = spark.createDataFrame([(-1, 3.0 * n + 10_000, 3.0 * n + 10_003, 0.9)], rows)
    late = spark.createDataFrame([(7, 2997.0, 3000.0, 0.9), (9, 30.0, 33.0, 0.9)], rows)
    path = str(tmp_path / "in")

    def arrive(df):
        df.write.mode("append").parquet(path)
        out = merge_vocal_stream(spark.readStream.schema(rows).parquet(path), "k", "30 seconds", chunk=777)
        (out.writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append")
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination())

    # out of order: the later half first, the earlier one in the same batch
    arrive(big.orderBy(F.desc("start")).unionByName(odd))
    arrive(marker)
    arrive(late)
    arrive(marker.withColumn("start", F.col("start") + 9000).withColumn("end", F.col("end") + 9000))
    got = sorted((r["k"], r["start"], r["end"], round(r["vocalness"], 9))
                 for r in spark.read.parquet(str(tmp_path / "out")).where("k IS NULL OR k <> -1").collect())
    want = sorted((r["k"], r["start"], r["end"], round(r["vocalness"], 9)) for r in S.merge_vocal(big, "k").collect())
    assert len(want) == n // 1000 and got == want


def test_an_open_island_waits_for_what_can_still_touch_it(spark, tmp_path):
    rows = "md5_encoded string, start double, end double, vocalness double"
    path = str(tmp_path / "in")

    def arrive(*values):
        spark.createDataFrame(list(values), rows).write.mode("append").parquet(path)
        out = merge_vocal_stream(spark.readStream.schema(rows).parquet(path), delay="0 seconds", longest=100.0)
        (out.writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append")
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination())

    # the watermark passes the end of a's first segment, but not the end of the one that continues it
    arrive(("a", 0.0, 10.0, 0.8), ("b", 0.0, 50.0, 0.9))
    arrive(("a", 10.0, 80.0, 0.6), ("c", 500.0, 501.0, 0.9))
    arrive(("c", 900.0, 901.0, 0.9))
    got = {(r["md5_encoded"], r["start"], r["end"], round(r["vocalness"], 9))
           for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {g for g in got if g[0] != "c"} == {("a", 0.0, 80.0, 0.7), ("b", 0.0, 50.0, 0.9)}


def test_a_large_batch_is_ranked_in_slices(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    corpus = spark.createDataFrame([(i, "x", [float(v) for v in rng.normal(size=4)]) for i in range(60)],
                                   "id bigint, label string, embedding array<double>")
    corpus.write.parquet(str(tmp_path / "in"))
    plain, sizes = tiles.top_k_stored, []

    def spy(queries, *more):
        sizes.append(queries.count())
        return plain(queries, *more)

    monkeypatch.setattr(tiles, "top_k_stored", spy)
    monkeypatch.setattr("versionlake.streaming.ranking.SLICE_ROWS", 20)
    stream = spark.readStream.schema(corpus.schema).parquet(str(tmp_path / "in"))
    rank_arrivals(stream, corpus, DenseScorer(), str(tmp_path / "out"), str(tmp_path / "cp"), k=3).awaitTermination()
    assert len(sizes) == 3 and max(sizes) < 40 and sum(sizes) == 60
    got = sorted((r["query_id"], r["rank"], r["corpus_id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted((r["query_id"], r["rank"], r["corpus_id"]) for r in tiles.top_k(corpus, corpus, DenseScorer(), 3).collect())
