import math
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from versionlake.functions.scorers import DenseScorer, MultiVectorScorer, SparseScorer, reduce_one, score_block
from versionlake.functions import scorers
from versionlake.operators import mining, ranking, tiles, vectors

RNG = np.random.default_rng(0)
N, D = 60, 8
VECTORS = RNG.normal(size=(N, D)).round(3)
VECTORS[7] = VECTORS[3]
LABELS = [i % 4 if i % 7 else 9 for i in range(N)]
LABELS[50] = None


@pytest.fixture(scope="module")
def items(spark):
    rows = [(f"r{i:02d}", None if LABELS[i] is None else f"c{LABELS[i]}", [float(x) for x in VECTORS[i]]) for i in range(N)]
    return spark.createDataFrame(rows, "id string, label string, embedding array<double>").cache()


def ranking_by_hand(scores):
    scores = np.round(scores, 9)
    return {i: [j for j in sorted(range(N), key=lambda j: (-scores[i, j], j)) if j != i] for i in range(N)}


def relevant(i, j):
    return LABELS[i] is not None and LABELS[i] == LABELS[j]


@pytest.mark.parametrize("mode", ["cosine", "dotsim", "sqeuc", "neuc"])
def test_top_k(items, mode):
    scores = score_block(VECTORS, VECTORS, mode) * (1 if mode in ("cosine", "dotsim") else -1)
    order = ranking_by_hand(scores)
    got = tiles.top_k(items, items, DenseScorer("embedding", mode), 5, cells=(3, 4)).collect()
    assert len(got) == N * 5
    for r in got:
        i, j = int(r["query_id"][1:]), int(r["corpus_id"][1:])
        assert order[i][r["rank"] - 1] == j and r["relevant"] == int(relevant(i, j))


@pytest.mark.parametrize("cell_rows", [5, 1000])
def test_first_relevant_with_hot_labels(items, cell_rows):
    order = ranking_by_hand(score_block(VECTORS, VECTORS, "cosine"))
    best = tiles.best_positive(items, items, DenseScorer(), cell_rows=cell_rows).collect()
    found = {int(r["query_id"][1:]): int(r["corpus_id"][1:]) for r in best}
    expected = {i: next(j for j in order[i] if relevant(i, j)) for i in range(N) if any(relevant(i, j) for j in order[i])}
    assert found == expected
    first = ranking.first_relevant(items, items, DenseScorer(), cells=(2, 3)).collect()
    assert {int(r["query_id"][1:]): r["rank"] for r in first} == {i: order[i].index(j) + 1 for i, j in expected.items()}
    ranked = tiles.top_k(items, items, DenseScorer(), 1, cells=(2, 2))
    again = ranking.first_relevant(items, items, DenseScorer(), ranked, cells=(2, 3)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, first))


@pytest.mark.parametrize("cell_rows", [5, 1000])
def test_excluded_pairs(spark, items, cell_rows):
    bad = {(i, j) for i in range(N) for j in range(N) if (i + 2 * j) % 5 == 0}
    exclude = spark.createDataFrame([(f"r{i:02d}", f"r{j:02d}") for i, j in bad] + [("r01", "nobody"), ("r01", None)],
                                    "query_id string, corpus_id string")
    whole = ranking_by_hand(score_block(VECTORS, VECTORS, "cosine"))
    order = {i: [j for j in js if (i, j) not in bad] for i, js in whole.items()}
    ranked = tiles.top_k(items, items, DenseScorer(), 6, cells=(3, 4), exclude=exclude)
    got = sorted((int(r["query_id"][1:]), r["rank"], int(r["corpus_id"][1:])) for r in ranked.collect())
    assert got == [(i, k + 1, order[i][k]) for i in range(N) for k in range(min(6, len(order[i])))]
    hits = {i: next((j for j in order[i] if relevant(i, j)), None) for i in range(N)}
    expected = {i: (j, order[i].index(j) + 1) for i, j in hits.items() if j is not None}
    best = tiles.best_positive(items, items, DenseScorer(), cell_rows=cell_rows, exclude=exclude).collect()
    assert {int(r["query_id"][1:]): int(r["corpus_id"][1:]) for r in best} == {i: j for i, (j, _) in expected.items()}
    first = ranking.first_relevant(items, items, DenseScorer(), cells=(2, 3), exclude=exclude).collect()
    assert {int(r["query_id"][1:]): (int(r["corpus_id"][1:]), r["rank"]) for r in first} == expected


@pytest.mark.parametrize("max_vectors", [2, 100])
def test_excluded_pairs_of_cut_records(spark, max_vectors):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, "x", rng.normal(size=(rng.integers(1, 7), 3)).round(3).tolist()) for i in range(9)],
                               "id long, label string, vectors array<array<double>>")
    exclude = spark.createDataFrame([(i, (i * 2 + 1) % 9) for i in range(9)], "query_id int, corpus_id int")
    scorer = MultiVectorScorer("vectors", "cos", "meanmin")
    plain, less = (tiles.top_k(df, df, scorer, 20, cells=(2, 2), max_vectors=max_vectors, exclude=e) for e in (None, exclude))
    wanted = {(r["query_id"], r["corpus_id"], r["score"]) for r in plain.collect() if r["corpus_id"] != (r["query_id"] * 2 + 1) % 9}
    assert {(r["query_id"], r["corpus_id"], r["score"]) for r in less.collect()} == wanted


def test_records_without_vectors(spark):
    rows = [(1, "x", [1.0, 0.0], [[1.0, 0.0]]), (2, "x", [0.9, 0.1], [[0.9, 0.1]]), (3, "x", [], []), (4, "x", None, None)]
    df = spark.createDataFrame(rows, "id long, label string, embedding array<double>, vectors array<array<double>>")
    for scorer in (DenseScorer(), MultiVectorScorer("vectors", "cos", "min")):
        assert {(r["query_id"], r["corpus_id"]) for r in tiles.top_k(df, df, scorer, 5).collect()} == {(1, 2), (2, 1)}
        best = tiles.best_positive(df, df, scorer).collect()
        assert {(r["query_id"], r["corpus_id"]) for r in best} == {(1, 2), (2, 1)}
        assert {(r["query_id"], r["rank"]) for r in ranking.first_relevant(df, df, scorer).collect()} == {(1, 1), (2, 1)}


@pytest.mark.parametrize("bar_rows", [3, 4096])
def test_full_ranking_metrics(items, bar_rows):
    order = ranking_by_hand(score_block(VECTORS, VECTORS, "cossim"))
    got = {int(r["query_id"][1:]): r for r in ranking.full_ranking_metrics(
        items, items, DenseScorer("embedding", "cossim"), bar_rows=bar_rows, cells=(2, 3)).collect()}
    for i, r in got.items():
        rel = np.array([relevant(i, j) for j in order[i]] + [False])
        rank = np.arange(1, N + 1)
        ap = (np.cumsum(rel) / rank)[rel].mean()
        rpc = 100 * (np.cumsum(~rel) / (~rel).sum())[rel].mean()
        assert (r["ap"], r["r1"], r["rpc"]) == (pytest.approx(ap), rank[rel][0], pytest.approx(rpc))


def test_percentile_golden(spark):
    rows = [("q", "x", [1.0, 0.0])] + [(f"d{i}", "x" if i in (1, 3) else f"n{i}", [1.0, 0.1 * (i + 1)]) for i in range(5)]
    df = spark.createDataFrame(rows, "id string, label string, embedding array<double>")
    r = ranking.full_ranking_metrics(df.where("id = 'q'"), df.where("id <> 'q'"), DenseScorer()).first()
    assert r["rpc"] == pytest.approx(50.0) and r["r1"] == 2 and r["ap"] == pytest.approx(0.5)


REDUX = ["min", "max", "mean", "minmean", "meanmin", "meanmax", "smeanmin", "best-3", "worst-2", "bestmin-2",
         "bpwr-3", "sbpwr-2", "sbest-2"]


@pytest.mark.parametrize("redux", REDUX)
@pytest.mark.parametrize("max_vectors", [2, 100])
def test_shingle_reductions_and_cut_records(spark, redux, max_vectors):
    rng = np.random.default_rng(4)
    sets = {f"s{i}": rng.normal(size=(rng.integers(1, 7), 3)).round(3) for i in range(9)}
    df = spark.createDataFrame([(k, "x", v.tolist()) for k, v in sets.items()], "id string, label string, vectors array<array<double>>")
    got = tiles.top_k(df, df, MultiVectorScorer("vectors", "cos", redux), 20, cells=(2, 2), max_vectors=max_vectors).collect()
    assert len(got) == 72
    for r in got:
        d = score_block(sets[r["query_id"]], sets[r["corpus_id"]], "cos")
        assert -r["score"] == pytest.approx(reduce_one(d, redux), abs=1e-8)


def test_best_pairs_golden():
    d = np.array([[0.1, 0.2, 0.9], [0.15, 0.8, 0.7]])
    assert reduce_one(d, "bpwr-2") == pytest.approx((0.1 + 0.7) / 2)
    assert reduce_one(d, "bpwr") == pytest.approx(0.4)


def test_sparse_scorer(spark):
    rng = np.random.default_rng(2)
    docs = [{f"t{t}": float(w) for t, w in zip(rng.choice(30, 6, replace=False), rng.random(6).round(3))} | {"all": 1.0} for _ in range(40)]
    df = spark.createDataFrame([(f"d{i:02d}", sorted(d), [d[t] for t in sorted(d)]) for i, d in enumerate(docs)],
                               "id string, terms array<string>, weights array<double>")
    for r in tiles.top_k(df, df, SparseScorer(), 39, cells=(2, 3)).collect():
        a, b = docs[int(r["query_id"][1:])], docs[int(r["corpus_id"][1:])]
        assert r["score"] == pytest.approx(sum(w * b.get(t, 0) for t, w in a.items()), abs=1e-8)


def test_fusion_is_a_mean_of_softmaxes(items):
    cos, dot = score_block(VECTORS, VECTORS, "cosine"), score_block(VECTORS, VECTORS, "dotsim")
    for m in (cos, dot):
        np.fill_diagonal(m, -np.inf)
    soft = sum(np.exp(m) / np.exp(m).sum(1, keepdims=True) for m in (cos, dot)) / 2
    scorer = ranking.fusion_scorer(DenseScorer(), DenseScorer("embedding", "dotsim"))
    for r in ranking.rank_results(items, items, scorer, 3, cells=(2, 3)).collect():
        assert r["score"] == pytest.approx(soft[int(r["query_id"][1:]), int(r["corpus_id"][1:])], abs=1e-8)
    with pytest.raises(ValueError):
        ranking.fusion_scorer(DenseScorer(), DenseScorer(), "sum")


def test_metrics_golden(spark):
    rows = [("q", f"d{r}", 1.0 - r / 100, r, int(r in (2, 4))) for r in range(1, 11)]
    ranked = spark.createDataFrame(rows, "query_id string, corpus_id string, score double, rank int, relevant int")
    first = spark.createDataFrame([("q", "d2", 2, 0.98)], "query_id string, corpus_id string, rank int, score double")
    queries = spark.createDataFrame([("q", 2)], "query_id string, n_relevant long")
    m = ranking.retrieval_metrics(ranked, first, queries).first()
    assert tuple(m) == (2.0, 0.0, 1.0, 1.0, 0.5)
    x = ranking.matrix_metrics(ranked, first, queries).first()
    assert (x["mean_ap"], x["top10"], x["rank1"], x["hit_rate"]) == (0.5, 0.2, 2.0, 0.0)
    none = queries.limit(0)
    assert ranking.retrieval_metrics(ranked.limit(0), first.limit(0), none).first()["MR1"] == 0.0


def test_outliers_and_hard_negatives(items):
    unit = VECTORS / np.linalg.norm(VECTORS, axis=1, keepdims=True)
    cos = unit @ unit.T
    for r in mining.clique_similarity(items).collect():
        i = int(r["id"][1:])
        others = [j for j in range(N) if j != i and relevant(i, j)]
        assert r["mean_similarity"] == pytest.approx(cos[i, others].mean())
    s = np.round(VECTORS @ VECTORS.T, 9)
    expected = {(i, j, k) for i in range(N) for j in range(i + 1, N) if relevant(i, j) and s[i, j] >= 5
                for k in range(N) if k != i and not relevant(i, k) and s[i, k] > s[i, j]}
    got = {tuple(int(r[c][1:]) for c in ("anchor", "positive", "hard_negative")) for r in mining.hard_negatives(items, 5.0).collect()}
    assert got == expected


def test_pairs_and_batches(spark):
    a = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0])], "id string, embedding array<double>")
    b = spark.createDataFrame([("x", [1.0, 1.0]), ("z", [0.0, 1.0])], "id string, embedding array<double>")
    assert [round(r["score"], 6) for r in vectors.paired_cosine(a, b).collect()] == [0.707107]
    with pytest.raises(ValueError):
        vectors.aligned_segments(a.where("id = 'y'"), b, "id")
    with pytest.raises(ValueError):
        vectors.aggregate_pairs(a.withColumnRenamed("id", "version_id"), b.withColumnRenamed("id", "version_id"), min_chunks=1)
    with pytest.raises(ValueError):
        tiles.model_scorer("unknown")
    assert tiles.model_scorer("clews").redux == "bpwr-5"


def test_stored_corpus_gives_the_same_and_is_not_shuffled(spark, items, tmp_path):
    scorer = DenseScorer()
    stored = tiles.store_by_cell(items, scorer, "stored_items", str(tmp_path / "stored"))
    try:
        queries = items.limit(7)
        got = tiles.top_k_stored(queries, stored, scorer, 4)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, tiles.top_k(queries, items, scorer, 4, cells=(1, 2)).collect()))
        # a plan of its own: one that ran prints its first form too
        plan = tiles.top_k_stored(queries, stored, scorer, 4)._jdf.queryExecution().executedPlan().toString()
        assert plan[plan.index("FlatMapCoGroups"):].count("Exchange hashpartitioning(gc") == 1 and "Bucketed: true" in plan
    finally:
        spark.sql("DROP TABLE stored_items")


@pytest.mark.parametrize("redux", ["best-3", "worst-3", "best-70", "worst-70", "bestmin-2", "bpwr-5", "bpwr", "sbestmin-2", "sbpwr-2"])
def test_reductions_take_pairs_of_a_size_together(redux, monkeypatch):
    rng = np.random.default_rng(5)
    q_counts, c_counts = rng.integers(1, 7, 20), rng.integers(1, 12, 25)
    d = rng.integers(0, 15, (q_counts.sum(), c_counts.sum())).astype(float)      # with ties
    if redux[:4] in ("best", "wors"):
        d[rng.random(d.shape) < 0.02] = np.nan
    q_ends, c_ends = np.cumsum(q_counts), np.cumsum(c_counts)
    want = np.array([[reduce_one(d[q - a:q, c - b:c], redux) for c, b in zip(c_ends, c_counts)]
                     for q, a in zip(q_ends, q_counts)])
    # one call of Python a pair of records made the shingle queries too slow
    monkeypatch.setattr(scorers, "reduce_one", None)
    monkeypatch.setattr(scorers, "REDUCED", 50)
    np.testing.assert_array_equal(scorers.reduce_grid(d, q_counts, c_counts, redux), want)


def test_small_cells_of_a_large_label_are_bounded(spark):
    """A row is copied by the cores there are, not by label / cell_rows, until cells are full."""
    def run(key, q, c):
        return pa.table({"n": [q.num_rows], "m": [c.num_rows]})

    rows = spark.range(6000).selectExpr("id", "if(id < 5000, 'hot', concat('c', id % 40)) AS label")
    cells = tiles.label_cells(rows, rows, SimpleNamespace(columns=[]), run, "n long, m long", cell_rows=10).collect()
    cores = spark.sparkContext.defaultParallelism
    hot = [(r["n"], r["m"]) for r in cells if r["n"] * r["m"] > 100 * 100]
    assert sum(n * m for n, m in hot) >= 5000 * 5000
    assert sum(n for n, _ in hot) <= 6000 * (np.sqrt(tiles.GRID_CELLS * cores) + 1)


def test_grid_copies_no_row_and_keeps_k_rows_a_query_and_task(spark):
    """Rows were copied to all cells by a shuffle, and every cell gave k rows a query."""
    rng = np.random.default_rng(5)
    vectors = rng.integers(-2, 3, (240, 4)).astype(float)  # few values, so that many scores tie
    vectors[:, 0] += 0.5
    rows = spark.createDataFrame([(i, "l", v.tolist()) for i, v in enumerate(vectors)], "id long, label string, embedding array<double>")
    scorer, k = DenseScorer("embedding", "dotsim"), 3
    schema = "query_id long, corpus_id long, score double, relevant int"
    found = tiles._grid(rows, rows, scorer, (16, 40), tiles._best_of_cell(scorer, k), schema, merge=tiles._best_of_both(k))
    assert found.count() <= math.ceil(40 / tiles.SPAN_CELLS) * k * 240
    assert found.groupBy("query_id", "corpus_id").count().where("count > 1").isEmpty()
    ranked = tiles.top_k(rows, rows, scorer, k, (16, 40))
    plan = ranked._jdf.queryExecution().toString()
    assert "CartesianProduct" in plan and "CoGroup" not in plan
    scores = np.round(vectors @ vectors.T, 9)
    np.fill_diagonal(scores, -np.inf)
    want = {(q, int(c), r + 1) for q in range(240) for r, c in enumerate(np.lexsort((np.arange(240), -scores[q]))[:k])}
    assert {(r.query_id, r.corpus_id, r.rank) for r in ranked.collect()} == want


@pytest.mark.parametrize("mode", ["cosine", "euc", "dotsim"])
def test_later_cells_are_read_from_the_bars_of_earlier_ones(mode, monkeypatch):
    rng = np.random.default_rng(7)
    points = (rng.normal(size=(200, 3)) * 20).round(1)
    points[50:90] = points[50]                       # ties, at the bar too
    table = pa.table({"label": [f"w{i % 5}" for i in range(200)], "id": list(range(200)), "embedding": points.tolist()})
    scorer, k = DenseScorer("embedding", mode), 7
    monkeypatch.setattr(tiles, "BLOCK_CELLS", 900)
    plainly, run, merge = tiles._best_of_cell(scorer, k), tiles._best_of_cell(scorer, k, True), tiles._best_of_both(k)
    parts = [table.take(pa.array(np.flatnonzero(rng.integers(0, 4, 200) == 0))) for _ in range(3)]
    cells = [table.filter(pa.array(np.arange(200) % 4 == i)) for i in range(4)]
    for q in [table, *parts]:
        plain = bounded = None
        for c in cells:
            found = plainly(None, q, c)
            fewer = run(None, q, c, bounded)
            assert bounded is None or fewer.num_rows < found.num_rows
            plain, bounded = (found, fewer) if plain is None else (merge(plain, found), merge(bounded, fewer))
        assert plain.sort_by([("query_id", "ascending"), ("corpus_id", "ascending")]).equals(
            bounded.sort_by([("query_id", "ascending"), ("corpus_id", "ascending")]))


def test_hard_negatives_leave_the_task_that_scored_them(spark, monkeypatch):
    """Rows equal a triple loop, with repeated ids and without a label; no pair above a bar is joined to the positives."""
    monkeypatch.setattr(tiles, "above_bar", None)
    monkeypatch.setattr(tiles, "OUT_ROWS", 7)
    rng = np.random.default_rng(7)
    points = rng.normal(size=(30, 3)).round(1)
    rows = [(i % 28, None if i % 9 == 8 else f"w{i % 4}", points[i].tolist()) for i in range(30)]
    df = spark.createDataFrame(rows, "id bigint, label string, embedding array<double>")
    s, want = np.round(points @ points.T, 9), []
    for a, (a_id, a_label, _) in enumerate(rows):
        for p, (p_id, p_label, _) in enumerate(rows):
            if a_label is None or a_label != p_label or a_id >= p_id or s[a, p] < 0.5:
                continue
            # a repeated anchor meets a pair's bar with each of its rows
            for other in (i for i, r in enumerate(rows) if r[0] == a_id):
                want += [(a_id, p_id, n_id, round(float(s[a, p]), 6), round(float(s[other, n]), 6)) for n, (n_id, n_label, _) in enumerate(rows)
                         if n_id != a_id and n_label != rows[other][1] and s[other, n] > s[a, p]]
    got = mining.hard_negatives(df, 0.5).collect()
    assert sorted((r["anchor"], r["positive"], r["hard_negative"], round(r["sim_ap"], 6), round(r["sim_an"], 6)) for r in got) == sorted(want)


def test_packed_rows_hold_a_word_once():
    """Terms of a packed row are numbered, which changes no score; repeated terms and records without terms included."""
    rng = np.random.default_rng(8)
    words = [f"a rather long word {i}" for i in range(40)]
    terms = [[words[j] for j in rng.integers(0, 40, n)] for n in (0, *rng.integers(1, 60, 49))]
    table = pa.table({"label": pa.nulls(50, pa.string()), "id": range(50), "terms": terms,
                      "weights": [rng.normal(size=len(t)).tolist() for t in terms]})
    scorer = SparseScorer()
    packed = tiles._packed_row(table.to_batches(), tiles.word_columns(scorer))["packed"][0]
    assert len(packed.as_buffer()) < sum(len(w) for t in terms for w in t)
    row = tiles._unpacked(packed)
    assert len(row["terms"].combine_chunks().values.dictionary) == 40
    want = [[sum(w * v for t, w in zip(a["terms"], a["weights"]) for u, v in zip(b["terms"], b["weights"]) if t == u)
             for b in table.to_pylist()] for a in table.to_pylist()]
    for left, right in ((table, table), (row, row), (row, table)):
        np.testing.assert_allclose(scorer.score(scorer.prepare(left), scorer.prepare(right), 0, 50), want, atol=1e-9)
