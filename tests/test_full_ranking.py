import numpy as np
import pyarrow as pa
import pytest

from versionlake.functions.scorers import DenseScorer
from versionlake.operators import ranking, tiles


def test_runs_are_merged_into_bounded_parts(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for query, entries, runs in (("small", 7, 3), ("one", 40, 1), ("hot", 500, 9), ("tied", 300, 6)):
        scores = rng.integers(0, 1 if query == "tied" else 50, entries) / 4.0
        placed = sorted((-float(s), int(i)) for i, s in enumerate(scores))
        want[query] = placed
        owner = rng.integers(0, runs, entries)
        for r in range(runs):
            own = [p for p in placed if owner[p[1]] == r]
            rows.append((query, [-s for s, _ in own], [i for _, i in own]))
    df = spark.createDataFrame(rows, "query_id string, scores array<double>, corpus_ids array<bigint>").repartition(3)
    for part_rows in (4, 20, 1000):
        found = {}
        for r in tiles.ranked_parts(df, part_rows).collect():
            assert 0 < len(r["scores"]) <= 2 * max(part_rows, 9)
            found.setdefault(r["query_id"], []).append((r["before"], [(-s, i) for s, i in zip(r["scores"], r["corpus_ids"])]))
        for query, placed in want.items():
            parts = sorted(found[query])
            assert [before for before, _ in parts] == list(np.cumsum([0, *[len(p) for _, p in parts]])[:-1])
            assert [x for _, p in parts for x in p] == placed


@pytest.mark.parametrize("biased", [False, True])
@pytest.mark.parametrize("skip", [False, True])
def test_metrics_of_a_hot_clique(spark, biased, skip):
    rng = np.random.default_rng(2)
    points = rng.normal(size=(90, 4)).round(1)
    points[40:60] = points[40]                       # ties
    labels = ["hot"] * 60 + [f"w{i // 3}" for i in range(27)] + [None, "alone", None]
    rows = [(i, labels[i], points[i].tolist()) for i in range(90)]
    df = spark.createDataFrame(rows, "id bigint, label string, embedding array<double>")
    pairs = [(i, j) for i in range(90) for j in range(90) if skip and (i + j) % 7 == 0]
    exclude = spark.createDataFrame(pairs, "query_id bigint, corpus_id bigint") if skip else None
    got = {r["query_id"]: r for r in ranking.full_ranking_metrics(
        df, df, DenseScorer("embedding", "dotsim"), biased, bar_rows=8, cells=(2, 3), exclude=exclude, cell_rows=16).collect()}
    scores = np.round(points @ points.T, 9)
    for q in range(90):
        others = sorted((j for j in range(90) if j != q and not (skip and (q + j) % 7 == 0)), key=lambda j: (-scores[q, j], j))
        hits = [n + 1 for n, j in enumerate(others) if labels[q] is not None and labels[j] == labels[q]]
        if not hits:
            assert q not in got
            continue
        n, total = len(hits), len(others) + 1
        ahead = [h - 1 for h in hits]
        percentile = sum(ahead) / (total - 1) / n if biased else sum(a - i for i, a in enumerate(ahead)) / (total - n) / n
        assert got[q]["n_relevant"] == n and got[q]["r1"] == hits[0]
        assert got[q]["ap"] == pytest.approx(sum((i + 1) / h for i, h in enumerate(hits)) / n)
        assert got[q]["rpc"] == pytest.approx(100 * percentile)


@pytest.mark.parametrize("held", [1, 200, 1_000_000])
def test_positives_stay_in_their_task(spark, monkeypatch, held):
    """Held scores give what written parts give; with copies of ids and vectors, and no positive is written."""
    rng = np.random.default_rng(5)
    points = rng.normal(size=(70, 3)).round(1)
    points[20:40] = points[20]
    rows = [(i % 60, f"w{i % 3}" if i % 60 % 11 else None, points[i % 60].tolist()) for i in range(70)]
    df = spark.createDataFrame(rows, "id bigint, label string, embedding array<double>")
    exclude = spark.createDataFrame([(i, j) for i in range(60) for j in range(80) if (i + j) % 9 == 0], "query_id bigint, corpus_id bigint")

    def metrics(skip, **more):
        out = ranking.full_ranking_metrics(df, df, DenseScorer("embedding", "dotsim"), cells=(2, 3), exclude=skip, **more)
        return sorted((r["query_id"], round(r["ap"], 9), r["r1"], round(r["rpc"], 9), r["n_relevant"]) for r in out.collect())

    want = [metrics(skip, held_scores=0, bar_rows=8, cell_rows=16) for skip in (None, exclude)]
    if held >= 70:
        monkeypatch.setattr(tiles, "positive_runs", None)
    assert [metrics(skip, held_scores=held) for skip in (None, exclude)] == want


def test_many_ties_are_placed_without_ranking_the_whole_corpus(monkeypatch):
    """Scores are held as whole numbers of four bytes; a query of its own id looks up only values that repeat."""
    monkeypatch.setattr(tiles, "_ahead", None)
    rng = np.random.default_rng(6)
    for digits, far in ((1, 0.3), (9, 0.3), (1, 300.0)):
        points = (rng.normal(size=(300, 2)) * far).round(digits)
        table = pa.table({"label": [str(i % 4) for i in range(300)], "id": rng.permutation(300),
                          "embedding": pa.array(list(points), pa.list_(pa.float64()))})
        cells = [tiles._Cell(DenseScorer("embedding", "dotsim"), table.slice(0, 40), table.slice(at, 100)) for at in (0, 100, 200)]
        held = [tiles._held(cell) for cell in cells]
        assert all(h.dtype == (np.float64 if far > 1 else np.int32) for h in held)
        got = tiles._places(cells[0].q, held, pa.chunked_array([c.c_ids for c in cells]),
                            pa.chunked_array([c.c["label"].combine_chunks() for c in cells])).to_pylist()
        scores, ids = np.round(points @ points.T, 9), table["id"].to_pylist()
        for q, row in enumerate(got):
            others = sorted((j for j in range(300) if j != q), key=lambda j: (-scores[q, j], ids[j]))
            places = [n + 1 for n, j in enumerate(others) if j % 4 == q % 4]
            assert (row["query_id"], row["r1"], row["n_relevant"]) == (ids[q], places[0], len(places))
            assert row["all_ahead"] == sum(places) - len(places)
            assert row["precision"] == pytest.approx(sum((i + 1) / p for i, p in enumerate(places)))
