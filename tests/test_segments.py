import pytest
from pyspark.sql import functions as F

from versionlake.operators import segments as S


def spans(df):
    return sorted((r["start"], r["end"]) for r in df.collect())


@pytest.mark.parametrize("rows, full, half", [
    ([(0, 3), (50, 60)], [(0, 13), (40, 70)], [(0, 8), (45, 65)]),
    ([(0, 65)], [(0, 30), (30, 60), (60, 65)], [(0, 30), (30, 60), (60, 65)]),
    ([(0, 60)], [(0, 30), (30, 60)], [(0, 30), (30, 60)]),
    ([(10, 20), (22, 30)], [(0, 30), (30, 40)], [(5, 35)]),
    ([(100, 103)], [(90, 113)], [(95, 108)]),
])
def test_pad_merge_slice(spark, rows, full, half):
    df = spark.createDataFrame([("a", float(s), float(e)) for s, e in rows], "md5_encoded string, start double, end double")
    assert spans(S.pad_merge_slice(df)) == full
    assert spans(S.pad_merge_slice(df, pad_mode="half")) == half


def vocal(spark, scores, start=0.0):
    rows = [("a", start + 3.0 * i, start + 3.0 * i + 3.0, v) for i, v in enumerate(scores)]
    return spark.createDataFrame(rows, "md5_encoded string, start double, end double, vocalness double")


def test_touching_merge_folds_pairwise(spark):
    got = S.merge_vocal(vocal(spark, [0.6, 0.8, 1.0])).collect()
    assert [(r["start"], r["end"], round(r["vocalness"], 9)) for r in got] == [(0.0, 9.0, 0.85)]
    assert spans(S.merge_vocal(vocal(spark, [0.6, 0.4, 1.0]))) == [(0.0, 3.0), (6.0, 9.0)]


@pytest.mark.parametrize("span", [4.0, 10.0, 3600.0])
def test_merge_does_not_depend_on_the_span(spark, span):
    scores = [0.9, 0.7, 0.2, 0.6, 0.95, 0.8, 0.55, 0.1, 0.3, 0.75] * 4
    expected, previous = [], None
    for i, v in enumerate(scores):
        if v > 0.5:
            if previous is not None and previous[1] == 3.0 * i:
                previous = (previous[0], 3.0 * i + 3.0, (previous[2] + v) / 2)
                expected[-1] = previous
            else:
                previous = (3.0 * i, 3.0 * i + 3.0, v)
                expected.append(previous)
    got = sorted((r["start"], r["end"], r["vocalness"]) for r in S.merge_vocal(vocal(spark, scores), span=span).collect())
    assert [(a, b, round(c, 9)) for a, b, c in got] == [(a, b, round(c, 9)) for a, b, c in expected]


@pytest.mark.parametrize("span", [5.0, 3600.0])
def test_windows_are_disjoint_and_keep_their_length(spark, span):
    rows = [("a", float(s), float(e)) for s, e in [(0, 40), (2, 3), (39, 41), (41, 42), (50, 51), (50.5, 60), (7, 8)]]
    df = spark.createDataFrame(rows, "md5_encoded string, start double, end double")
    merged = S.merge_windows(df, span=span)
    assert spans(merged) == [(0.0, 42.0), (50.0, 60.0)]
    pieces = spans(S.slice_windows(merged, 7.0))
    assert sum(e - s for s, e in pieces) == 52.0 and all(e - s <= 7.0 for s, e in pieces)


def test_detection_record(spark):
    segs = vocal(spark, [0.9, 0.8]).union(vocal(spark, [0.1, 0.9, 0.1]).withColumn("md5_encoded", F.lit("b")))
    names = spark.createDataFrame([("a", "V-1"), ("b", None), ("c", "V-3")], "md5_encoded string, version_id string")
    got = {r["md5_encoded"]: r for r in S.count_columns(S.detection_record(segs, names)).collect()}
    assert got["a"]["is_vocal"] and got["a"]["nb_audio_chunks"] == 1
    assert not got["b"]["is_vocal"] and got["b"]["nb_vocal_segments"] == 1 and got["b"]["nb_audio_chunks"] == 0
    assert got["b"]["version_id"] == "" and got["c"]["vocalness_score"] == 0.0 and got["c"]["res_detection"] == []


def test_fixed_windows(spark):
    df = spark.createDataFrame([("p", 44.0), ("q", 5.0), ("r", 45.0)], "perf string, dur_s double")
    got = sorted(r["perf"] for r in S.fixed_windows(df, 15.0, 15.0).collect())
    assert got == ["p-▁start-0", "p-▁start-15", "q-▁start-0", "r-▁start-0", "r-▁start-15"]


def test_frames(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0, 3.0, 4.0, 5.0])], "id string, f array<double>")
    assert S.shingle_frames(df, "f", 3, 2).first()["shingles"] == [[1, 2, 3], [3, 4, 5]]
    assert S.shingle_frames(df, "f", 4, 3).first()["shingles"] == [[1, 2, 3, 4], [4, 5, 0, 0]]
    assert S.shingle_frames(df, "f", 4, 3, "repeat").first()["shingles"] == [[1, 2, 3, 4], [4, 5, 1, 2]]
    assert S.shingle_frames(df, "f", 4, 3, None).first()["shingles"] == [[1, 2, 3, 4]]
    assert S.frame_chunk(df, "f", 4, 3).first()["chunk"] == [4, 5, -100, -100]


def test_align_keeps_the_longest_chunks(spark):
    chunks = spark.createDataFrame([("a", 0.0, 5.0), ("a", 10.0, 40.0), ("a", 50.0, 60.0)], "md5_encoded string, start double, end double")
    pieces = spark.createDataFrame([("a", ["x", "y"])], "md5_encoded string, pieces array<string>")
    got = sorted((r["chunk_id"], r["start"], r["transcription"]) for r in S.align_pieces(chunks, pieces).collect())
    assert got == [(0, 10.0, "x"), (1, 50.0, "y")]
