import numpy as np
import pytest

from versionlake.functions.scorers import MultiVectorScorer, reduce_one, score_block
from versionlake.operators import tiles, vectors


def frame(spark, rows):
    return spark.createDataFrame(rows, "id int, embedding array<double>")


def test_covariance_penalty(spark):
    points = np.random.default_rng(3).normal(size=(70, 7)) @ np.random.default_rng(4).normal(size=(7, 7)) + 100
    df = frame(spark, [(i, p.tolist()) for i, p in enumerate(points)] + [(98, None), (99, [])]).repartition(6)
    cov = np.cov(points.T)
    want = np.mean([cov[i, j] ** 2 for i in range(7) for j in range(i)])
    for width in (2, 3, 64):
        assert vectors.covariance_penalty(df, width=width).first()["penalty"] == pytest.approx(want)
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [3.0])]):
        assert vectors.covariance_penalty(frame(spark, rows)).first()["penalty"] is None


@pytest.mark.parametrize("redux", ["bpwr-5", "bpwr-2", "min", "smeanmin", "mean", "best-3"])
def test_masked_vectors_take_no_part(spark, redux):
    rng = np.random.default_rng(5)
    rows, left = [], {}
    for i in range(12):
        v = rng.normal(size=(rng.integers(1, 7), 3))
        mask = [bool(m) for m in rng.integers(0, 2, len(v))] if i % 4 else [True] * len(v)
        rows.append((f"r{i:02d}", "a", v.tolist(), None if i == 5 else mask))
        kept = v if i == 5 else v[~np.array(mask)]
        if len(kept):
            left[f"r{i:02d}"] = kept
    df = tiles.unmasked(spark.createDataFrame(rows, "id string, label string, vectors array<array<double>>, mask array<boolean>"))
    assert "mask" not in df.columns
    for size in (4096, 2):
        got = {(r["query_id"], r["corpus_id"]): -r["score"] for r in tiles.top_k(
            df, df, MultiVectorScorer("vectors", "nsqeuc", redux), 50, cells=(2, 2), max_vectors=size).collect()}
        assert got.keys() == {(a, b) for a in left for b in left if a != b}
        for (a, b), far in got.items():
            assert far == pytest.approx(reduce_one(score_block(left[a], left[b], "nsqeuc"), redux), abs=1e-8)


def test_frame_shift_of_all_pairs_of_a_work(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(30, 5))
    rows, chunks = [], {}
    for perf, (work, start) in enumerate([("w", s) for s in (0, 2, 3, 5, 5)] + [("x", 0), ("x", 1), ("y", 0), (None, 0), (None, 1)]):
        index = [i for i in range(9) if perf != 3 or i % 2]
        own = base[[start + i for i in index]] + rng.normal(size=(len(index), 5)) * 0.01
        chunks[perf] = (work, index, own)
        rows += [(work, perf, i, e.tolist()) for i, e in zip(index, own)]
    rows += [("z", 100, 0, [0.0] * 5), ("z", 101, 0, [1.0] * 5)]      # no chunk at another index
    df = spark.createDataFrame(rows, "work_id string, perf int, idx int, embedding array<double>").repartition(4)
    want = {(p, p): 0 for p, (work, _, _) in chunks.items() if work} | {(100, 100): 0, (101, 101): 0}
    for a, (work, ia, ea) in chunks.items():
        for b, (other, ib, eb) in chunks.items():
            if a == b or work is None or work != other:
                continue
            votes = []
            for i, e in zip(ia, ea):
                far = sorted((round(float(np.linalg.norm(e - f)), 9), j) for j, f in zip(ib, eb) if i != j)
                votes.append(i - far[0][1])
            want[a, b] = max(votes, key=lambda v: (votes.count(v), -votes.index(v)))
    for cell_rows in (8192, 10):
        got = {(r[0], r[1]): r[2] for r in vectors.frame_shift_all(df, cell_rows=cell_rows).collect()}
        assert got == want
    pairs = spark.createDataFrame([k for k in want if k[0] < 100], "perf_i int, perf_j int")
    given = {(r[0], r[1]): r[2] for r in vectors.frame_shift(df, pairs).collect()}
    assert given == {k: v for k, v in want.items() if k[0] < 100}


@pytest.mark.parametrize("cell_rows", [8192, 6])
def test_reports_of_batches(spark, cell_rows):
    rng = np.random.default_rng(7)
    rows, batches = [], {}
    for batch, n in (("big", 40), ("small", 3), ("one", 1), (None, 5)):
        left, right = rng.normal(size=(n, 4)), rng.normal(size=(n, 4))
        left, right = left + 0.5 * right, right.round(1)
        right[: n // 3] = right[0]                                   # ties
        batches[batch] = left, right
        rows += [(batch, i, x.tolist(), y.tolist(), "extra") for i, (x, y) in enumerate(zip(left, right))]
    df = spark.createDataFrame(rows, "batch_id string, id int, embedding_a array<double>, embedding_b array<double>, label string")
    found = {r["batch_id"]: r for r in vectors.retrieval_in_batch(df.repartition(3), cell_rows=cell_rows).collect()}
    report = {r["batch_id"]: r for r in vectors.alignment_in_batch(df.repartition(3), cell_rows=cell_rows).collect()}
    assert found.keys() == report.keys() == batches.keys()
    for batch, (left, right) in batches.items():
        sim = np.round(left @ right.T, 9)
        n = len(sim)
        rank = np.array([1 + sum(sim[i, j] > sim[i, i] or sim[i, j] == sim[i, i] and j < i for j in range(n)) for i in range(n)])
        got = found[batch]
        assert [got["HR1"], got["HR5"], got["HR10"]] == pytest.approx([(rank <= k).mean() for k in (1, 5, 10)])
        assert got["MAP10"] == pytest.approx(np.where(rank <= 10, 1 / rank, 0).mean())
        assert got["cosine_sim"] == pytest.approx(np.diag(sim).mean())
        cross, a, b = (score_block(x, y, "cosine") for x, y in ((left, right), (left, left), (right, right)))
        logits = cross / 0.07
        want = [1 - np.diag(cross).mean(), ((a - b) ** 2).mean(), (np.log(np.exp(logits).sum(1)) - np.diag(logits)).mean()]
        assert [report[batch][c] for c in ("l_cos", "l_mse", "contrastive")] == pytest.approx(want)
        assert report[batch]["total"] == pytest.approx((want[0] + want[1]) / 2)
    assert vectors.retrieval_in_batch(df.limit(0)).count() == 0
