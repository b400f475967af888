import numpy as np
import pytest
from pyspark.sql import functions as F

from versionlake.functions.seeded import seeded_hash
from versionlake.operators import ids, infer, numbering, reports, rerank, splits
from versionlake.plans import datasets, evaluate
from versionlake.sources import readers, writers


def test_numbering(spark):
    df = spark.range(1000).withColumn("k", F.when(F.col("id") < 700, 0).otherwise(F.col("id") % 9)).withColumn("h", seeded_hash(1, "id"))
    rows = numbering.number_by_hash(df, "h").orderBy("h").collect()
    assert [r["row_no"] for r in rows] == list(range(1, 1001))
    assert [r["n"] for r in numbering.number_rows(df, [F.col("id")], "n").orderBy("id").collect()] == list(range(1, 1001))
    hot = {r["id"]: r["row_no"] for r in numbering.number_within(df, ["k"], "h", hot_rows=100).collect()}
    plain = {r["id"]: r["row_no"] for r in numbering.number_within(df, ["k"], "h").collect()}
    assert hot == plain


@pytest.mark.parametrize("buckets", [2, 7, 1000])
def test_exact_quantiles(spark, buckets):
    values = [1.0, 2.0, 3.0, 10.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert numbering.quantile_values(df, "v", [.25, .5, .75], buckets=buckets) == [1.75, 2.5, 4.75]
    rng = np.random.default_rng(0)
    data = np.concatenate([np.full(300, 5.0), rng.normal(size=500).round(2) * 10])
    df = spark.createDataFrame([(float(v),) for v in data], "v double")
    got = numbering.quantile_values(df, "v", [0.0, .1, .5, .9, 1.0], buckets=buckets)
    assert got == pytest.approx(list(np.quantile(data, [0, .1, .5, .9, 1])))


def test_quantiles_as_a_plan(spark):
    tiny, huge = 5e-324, 1.7e308
    data = [-huge, -1.0, -tiny, -0.0, 0.0, tiny, 1e-300, 1.0, np.nextafter(1.0, 2.0), 7.0, huge, float("inf")]
    data += [3.0] * 500
    df = spark.createDataFrame([(float(v),) for v in data] + [(None,)], "v double").repartition(5)
    probabilities = [i / (len(data) - 1) for i in range(0, len(data) - 1, 7)] + [1.0]
    got = {r["probability"]: r["value"] for r in numbering.quantiles(df, "v", probabilities, "nearest").collect()}
    want = np.sort(np.array(data))
    assert [got[q] for q in probabilities] == [want[round(q * (len(data) - 1))] for q in probabilities]
    assert len(probabilities) == len(got)
    low = numbering.quantile_values(df, "v", [i / (len(data) - 1) for i in range(9)], "nearest")
    assert low == list(want[:9])
    # infinity beside a finite neighbour, only when a share of it is taken
    assert numbering.quantile_values(df, "v", [1.0, 0.0]) == [float("inf"), -huge]
    nothing = numbering.quantiles(df.where("v > 5 and v < 0"), "v", [0.5, 0.1]).collect()
    assert sorted(nothing) == [(0.1, None), (0.5, None)]
    assert np.isnan(numbering.quantile_values(df.where("v is null"), "v", [0.5])[0])
    nan = spark.createDataFrame([(1.0,), (float("nan"),), (2.0,)], "v double")
    assert numbering.quantile_values(nan, "v", [0.0, 0.5]) == [1.0, 2.0]


def test_quartile_subsets(spark):
    df = spark.createDataFrame([(i, float(i % 10)) for i in range(100)] + [(100, None)], "id int, v double")
    parts = splits.quartile_subsets(df, "v")
    values = np.array([i % 10 for i in range(100)])
    for name, q in (("q1", .25), ("median", .5), ("q3", .75)):
        assert parts[name].count() == int((values >= np.quantile(values, q)).sum())
    assert all(p.count() == 0 for p in splits.quartile_subsets(df.where("v is null"), "v").values())


def test_uid(spark):
    df = spark.createDataFrame([("V-12_34", 5), ("ab_c", 1)], "v string, c int")
    rows = df.select(ids.chunk_uid(F.col("v"), F.col("c")), ids.chunk_uid(F.col("v"), F.col("c"), True)).collect()
    assert [tuple(r) for r in rows] == [("12345", "12345"), ("abc1", "ab_c1")]
    with pytest.raises(ValueError, match="missing columns"):
        ids.require_columns(df, ["x", "v"])
    with pytest.raises(ValueError):
        ids.normalize_vocals(df)


def test_splits(spark):
    df = spark.range(101).withColumn("work", F.col("id") % 10)
    got = dict(splits.train_val_test(df, "id").groupBy("split").count().collect())
    assert got == {"train": 81, "val": 10, "test": 10}
    rows = splits.split_by_work(df, "id", "work", val_unseen=0.1, test_unseen=0.2, val_ratio=0.2, test_ratio=0.2).collect()
    assert len(rows) == 101
    by_work = {}
    for r in rows:
        by_work.setdefault(r["work"], set()).add(r["split"])
    assert sorted(len(s) for s in by_work.values()) == [1, 1, 1] + [3] * 7
    folds = splits.stratified_folds(df, "id", "work", 5).groupBy("work", "fold").count().collect()
    assert all(r["count"] in (2, 3) for r in folds)


def test_class_batches(spark):
    df = spark.createDataFrame([(i, "big" if i < 60 else f"c{i % 7}") for i in range(75)], "id int, label string")
    rows = splits.per_class_batches(df, "id", "label", m=4, batch_size=16).collect()
    total = 60 + sum(4 if n < 4 else n for n in [3, 2, 2, 2, 2, 2, 2])
    assert len({r["batch_id"] for r in rows}) <= total // 16 + 1
    for b in {r["batch_id"] for r in rows}:
        slots = [r for r in rows if r["batch_id"] == b]
        assert len(slots) == 16 and len({r["label"] for r in slots}) == 4
        big = [r["id"] for r in slots if r["label"] == "big"]
        assert len(big) == len(set(big))
    with pytest.raises(ValueError):
        splits.per_class_batches(df, "id", "label", m=3, batch_size=16)


@pytest.mark.parametrize("p", [0.0, 1.0])
def test_anchor_groups(spark, p):
    df = spark.createDataFrame([(i, "a" if i < 2 else "b") for i in range(9)] + [(99, "alone")], "id int, clique string")
    rows = splits.anchor_groups(df, "id", "clique", 5, p_samesong=p).collect()
    assert len(rows) == 45
    for i in range(9):
        group = {r["slot"]: r["member"] for r in rows if r["anchor"] == i}
        assert group[0] == i and all((m < 2) == (i < 2) for m in group.values())
        if p == 0.0:
            assert i not in [group[s] for s in range(1, 5)]
            assert len({group[s] for s in range(1, 5)}) == (1 if i < 2 else 4)


def test_reports(spark):
    base = spark.createDataFrame([("m", 0.4, 0.4, 0.4, 0.4)], "model_name string, MR1 double, HR1 double, HR10 double, MAP10 double")
    res = spark.createDataFrame([("m", 0.5, 0.5, 0.5, 0.5), ("new", 0.5, 0.5, 0.5, 0.5)], base.schema)
    got = {r["model_name"]: r["HR1"] for r in reports.report_reranked(res, base).collect()}
    assert got == {"m": "0.500 (0.100)", "new": "0.500 (nan)"}
    fused = reports.report_fused(spark.createDataFrame([("m+BM25+max", 0.5, 0.5, 0.5, 0.5), ("BM25", 0.1, 0.1, 0.1, 0.1)], base.schema), base)
    assert [(r["type"], r["model_name"], r["MR1"]) for r in fused.collect()] == [
        ("Individual Models", "BM25", "0.100"), ("BM25 Max", "m", "0.500 (0.100)")]
    times = spark.createDataFrame([("s", 0, 9.0), ("s", 1, 1.0), ("s", 2, 3.0), ("t", 0, 1.0)], "stage string, idx int, seconds double")
    rows = {r["stage"]: r for r in reports.timing_summary(times, 1).collect()}
    assert (rows["s"]["mean"], rows["s"]["std"]) == (2.0, 1.0) and np.isnan(rows["t"]["mean"])
    log = spark.createDataFrame([(1, "a", .5), (2, "a", .9), (2, "b", .1), (3, "b", .8)], "epoch int, test_set string, map double")
    assert tuple(reports.best_epoch(log, 3, 2).first()) == (3, pytest.approx(0.85))


def test_rerank(spark):
    ranked = spark.createDataFrame([("q", "a", .9, 1, 0), ("q", "b", .8, 2, 1), ("p", "a", .7, 1, 0)],
                                   "query_id string, corpus_id string, score double, rank int, relevant int")
    texts = spark.createDataFrame([("q", "red green blue"), ("a", "black"), ("b", "red green")], "version_id string, text string")
    kept = rerank.filter_candidates(ranked)
    # the relevant candidate lies outside the corpus: the query stays, with the candidates inside
    inside = rerank.filter_candidates(ranked, spark.createDataFrame([("a",)], "id string"))
    assert [r["corpus_id"] for r in inside.collect()] == ["a"]
    got = rerank.rerank(kept, texts, infer.jaccard_scorer).orderBy("rank").collect()
    assert [(r["corpus_id"], r["rank"]) for r in got] == [("b", 1), ("a", 2)]
    score = infer.pandas_scorer(lambda: (lambda pairs: [float(len(d)) for _, d in pairs]), "length")
    assert rerank.rerank(kept, texts, score).orderBy("rank").first()["corpus_id"] == "b"
    recordings = spark.createDataFrame([("q", "w", "red green blue"), ("b", "w", "red green"), ("a", "z", "black")],
                                       "version_id string, clique_id string, text string")
    run = evaluate.rerank_run(ranked, recordings, infer.jaccard_scorer, "text")
    assert run.metrics.first()["HR1"] == 1.0


def test_encoder_failures(spark):
    def factory():
        def model(items):
            if "bad" in items:
                raise RuntimeError("bad")
            return [[float(len(x))] for x in items]
        return model
    df = spark.createDataFrame([(1, "abc"), (2, "bad"), (3, None), (4, "z")], "id int, t string")
    got = {r["id"]: (r["embedding"], r["status"]) for r in infer.encode_column(df, "t", factory, "failing").collect()}
    assert got == {1: ([3.0], "ok"), 2: ([], "failed"), 3: ([], "empty"), 4: ([1.0], "ok")}


def test_evaluate_arguments(spark):
    df = spark.createDataFrame([("a", "x")], "version_id string, clique_id string")
    for bad in (dict(method="magic"), dict(method="dense"), dict(method="bm25"), dict(method="fusion", embeddings=df)):
        with pytest.raises(ValueError):
            evaluate.evaluate(recordings=df, **bad)


def test_training_chunks(spark):
    meta = spark.createDataFrame([("V-1", "c", "m1"), ("V-2", "c", "m2")], "version_id string, clique_id string, md5_encoded string")
    texts = spark.createDataFrame([("m1.tar.mp3", "first part\n\n \n\nsecond part")], "file string, transcription string")
    vocals = spark.createDataFrame([("m1", [(0.0, 3.0), (50.0, 60.0)], 0.8)], "md5_encoded string, vocal_segments array<struct<start:double,end:double>>, vocalness_score double")
    rows = datasets.training_chunks(meta, texts, vocals).orderBy("chunk_id").collect()
    assert [(r["start"], r["end"], r["transcription"]) for r in rows] == [(0.0, 8.0, "first part"), (45.0, 65.0, "second part")]
    bare = datasets.training_chunks(meta.withColumn("deezer_id", F.lit(5)), texts, vocals.drop("vocalness_score"))
    assert [(r["chunk_id"], r["deezer_id"], r["vocalness"]) for r in bare.orderBy("chunk_id").collect()] == [
        (r["chunk_id"], 5, None) for r in rows]


def test_literals_keep_marks_in_strings(spark):
    values = [["it's (ok)", "a,]", 'say "hi"'], ["both ' and \"", "back\\slash", "\x85", "None True"], [], ["tab\t", "é"]]
    df = spark.createDataFrame([(i, repr(v)) for i, v in enumerate(values)] + [(9, None), (10, "['open")], "i int, cell string")
    got = {r["i"]: r["v"] for r in df.select("i", readers.parse_literal(F.col("cell"), "array<string>").alias("v")).collect()}
    assert got == {**dict(enumerate(values)), 9: None, 10: None}
    mixed = spark.createDataFrame([("[{'a': 'x', 'b': None, 'c': True}, {'a': \"it's\", 'b': 2.5, 'c': False,}]",)], "cell string")
    rows = mixed.select(readers.parse_literal(F.col("cell"), "array<struct<a string, b double, c boolean>>").alias("v")).first()["v"]
    assert [tuple(r) for r in rows] == [("x", None, True), ("it's", 2.5, False)]


def test_readers_and_writers(spark, tmp_path):
    path = str(tmp_path / "meta.csv")
    with open(path, "w") as f:
        f.write('version_id,md5_encoded,score\n007,aa,1.5\n008,"b\nb",NaN\n')
    df = readers.read_metadata(spark, path, {"version_id": "string", "md5_encoded": "string", "score": "double"}, ["score"])
    assert sorted((r["version_id"], r["score"]) for r in df.collect()) == [("007", 1.5), ("008", None)]
    with open(tmp_path / "bad.csv", "w") as f:
        f.write("a,b\n1,2\nx,y\n3,4\n")
    assert readers.read_lenient_csv(spark, str(tmp_path / "bad.csv"), {"a": "int", "b": "int"}).select("a").count() >= 2
    kept = readers.read_lenient_csv(spark, str(tmp_path / "bad.csv"), {"a": "int", "b": "int"}, keep_bad=True).cache()
    assert kept.where("_corrupt_record is not null").count() == 1
    with open(tmp_path / "short.csv", "w") as f:
        f.write('a,b,c\n1,2,3\n4,5\n6,7,8,9\n10,"x,y",11\n')
    lenient = readers.read_lenient_csv(spark, str(tmp_path / "short.csv"), {"a": "int", "b": "string", "c": "int"})
    assert sorted(map(tuple, lenient.collect())) == [(1, "2", 3), (4, "5", None), (10, "x,y", 11)]
    assert lenient.count() == lenient.select("b").count() == 3
    with open(tmp_path / "lines.txt", "w") as f:
        f.write('{"perf": "p1", "len": 3}\n\nperf:p2\twork:a:b\tlen:4\n')
    rows = readers.read_lines(spark, str(tmp_path / "lines.txt"), {"perf": "string", "work": "string", "len": "int"}).collect()
    assert sorted(map(tuple, rows), key=str) == [("p1", None, 3), ("p2", "a:b", 4)]
    np.savez(tmp_path / "e.npz", a=np.ones((2, 3)), b=np.zeros(3))
    emb = readers.import_npz(spark, str(tmp_path / "e.npz"))
    writers.write_embeddings(emb, str(tmp_path / "emb"))
    single = readers.read_embeddings(spark, str(tmp_path / "emb"), single=True).orderBy("id").collect()
    assert [(r["id"], r["embedding"]) for r in single] == [("a", [1.0] * 3), ("b", [0.0] * 3)]
    with pytest.raises(ValueError):
        writers.write_embeddings(emb, str(tmp_path / "x"), "pickle")
    with pytest.raises(ValueError):
        writers.write_lines(emb.limit(0), str(tmp_path / "y"))
    (tmp_path / "audio" / "sub").mkdir(parents=True)
    for name in ("a.mp3", "sub/b.mp3", "c.txt"):
        (tmp_path / "audio" / name).write_bytes(b"123")
    manifest = readers.read_manifest(spark, str(tmp_path / "audio"))
    assert sorted((r["name"], r["length"]) for r in manifest.collect()) == [("a", 3), ("b", 3)]
    have, absent = ids.with_files(spark.createDataFrame([("a",), ("z",)], "md5_encoded string"), manifest)
    assert have.count() == 1 and absent.first()["md5_encoded"] == "z"
    writers.write_csv(spark.createDataFrame([("q", "c1"), ("q", "c0")], "query_id string, corpus_id string"), str(tmp_path / "truth"))
    assert readers.positives_by_query(readers.read_truth(spark, str(tmp_path / "truth"))).first()["positives"] == ["c0", "c1"]
    writers.write_ids(emb, "id", str(tmp_path / "ids"))
    assert readers.read_plain(spark, str(tmp_path / "ids"), "txt").distinct().count() == 2
    with pytest.raises(ValueError):
        readers.read_plain(spark, path, "xml")


def test_shards_and_resume(spark, tmp_path):
    meta = spark.range(25).select(F.format_string("u%03d", "id").alias("uid"))
    features = meta.where("uid <> 'u003'").withColumn("x", F.lit(1))
    counts = writers.write_shards(meta, features, meta.withColumn("y", F.lit(2)), str(tmp_path / "s"), shard_size=10)
    assert counts == {"kept": 24, "missing": 1}
    part = readers.read_shards(spark, str(tmp_path / "s"), last_shard=1)
    assert part.count() == 20 and "u010" in [r["uid"] for r in part.collect()]
    assert readers.read_shards(spark, str(tmp_path / "s"), batch_size=8).select("batch_id").distinct().count() == 3
    out = str(tmp_path / "done")
    first = spark.createDataFrame([("a",), ("b",)], "md5_encoded string")
    assert writers.append_pending(first, out).count() == 2
    more = first.union(spark.createDataFrame([("c",)], "md5_encoded string"))
    assert [r[0] for r in writers.append_pending(more, out).collect()] == ["c"]
    assert spark.read.parquet(out).count() == 3


def test_literals(spark):
    df = spark.createDataFrame([("[(0.0, 13.5), (40.0, 70.0)]", "[{'start': 0.0, 'end': 3.0, 'vocalness': 0.9}]"), ("oops", None)], "c string, s string")
    out = df.select("c", readers.parse_pairs(F.col("c")).alias("p"), readers.parse_segments(F.col("s")).alias("g"))
    row = out.first()
    assert [tuple(x) for x in row["p"]] == [(0.0, 13.5), (40.0, 70.0)] and row["g"][0]["vocalness"] == 0.9
    assert readers.unparsed_count(out, "c", "p").first()[0] == 1


def test_pair_models_get_few_pairs_and_texts_many_partitions(spark, monkeypatch):
    def model():
        def score(pairs):
            if len(pairs) > 4:
                raise ValueError("too many pairs at once")
            return [float(len(q) - len(d)) for q, d in pairs]
        return score

    ranked = spark.createDataFrame([(i, j, j + 1, i % 2) for i in range(5) for j in range(9)],
                                   "query_id int, corpus_id int, rank int, relevant int")
    texts = spark.createDataFrame([(i, "x" * i) for i in range(9)], "version_id int, text string")
    monkeypatch.setattr(rerank, "PART_TEXTS", 1)
    out = rerank.rerank(ranked, texts, infer.pandas_scorer(model, "few", 4))
    assert out._jdf.queryExecution().toString().count(", 9), REPARTITION_BY_NUM") >= 2
    assert sorted((r["query_id"], r["corpus_id"], r["score"], r["rank"]) for r in out.collect()) == [
        (i, j, float(i - j), j + 1) for i in range(5) for j in range(9)]
