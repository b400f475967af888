import numpy as np
import pytest

from versionlake.functions.scorers import SparseScorer
from versionlake.operators import lexical, postings, tiles


def records(seed, n, words, hot, clumsy=True):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        own = {f"t{int(t)}": float(w) for t, w in zip(rng.zipf(1.4, words) % 60, rng.integers(1, 4, words) / 2)}
        if i % 3:
            own |= {h: 0.25 for h in hot}
        out.append((i, f"w{i % 7}" if i % 5 else None, sorted(own), [own[t] for t in sorted(own)], "extra"))
    if clumsy:
        out += [(n, "w1", [], [], "x"), (n + 1, "w2", None, None, "x"), (n + 2, "w3", ["only"], [1.0], "x"),
                (n + 3, "w1", ["t1", "t2"], [0.0, 1e-12], "x")]
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "id bigint, label string, terms array<string>, weights array<double>, score string")


def rows_of(df):
    return sorted((r["query_id"], r["rank"], r["corpus_id"], round(r["score"], 8), r["relevant"]) for r in df.collect())


@pytest.mark.parametrize("k,hot,first", [(1, 5, 1), (10, 1_000_000, 1), (10, 20, 20), (300, 50, 20)])
def test_postings_give_the_rows_of_the_tiles(spark, k, hot, first):
    corpus = frame(spark, records(1, 220, 12, ["the", "of"]))
    queries = frame(spark, [(i + 100, *r[1:]) for i, r in enumerate(records(2, 25, 5, ["the"], False))] + [
        (900, "w1", [], [], "x"), (901, None, ["unseen"], [2.0], "x"), (902, "w2", ["the"], [1.0], "x")])
    exclude = spark.createDataFrame([(100 + i, j) for i in range(0, 25, 2) for j in range(0, 60, i + 1)] + [(902, 1)],
                                    "query_id bigint, corpus_id bigint")
    for skip in (None, exclude):
        want = rows_of(tiles.top_k(queries, corpus, SparseScorer(), k, cells=(2, 3), exclude=skip))
        assert rows_of(postings.top_k(queries, corpus, k, skip, first_round=first, hot_postings=hot)) == want


def test_bounds_leave_frequent_words_unread(spark):
    """With a word of all records next to rare ones, the second round must not read its postings."""
    rows = [(i, None, ["the", f"r{i % 10}"], [0.01, 1.0], "x") for i in range(200)]
    corpus = frame(spark, rows)
    queries = frame(spark, [(1000, None, ["r3", "the"], [1.0, 1.0], "x")])
    read = []
    plain = postings._scored

    def spy(asked, lists, out):
        read.append(sorted(r["term"] for r in asked.select("term").distinct().collect()))
        return plain(asked, lists, out)

    postings._scored = spy
    try:
        got = rows_of(postings.top_k(queries, corpus, 5, first_round=4))
    finally:
        postings._scored = plain
    assert read == [["r3"], ["r3"]]
    assert got == [(1000, j + 1, 3 + 10 * j, 1.01, 0) for j in range(5)]


def test_postings_of_nothing_and_negative_weights(spark):
    some = frame(spark, records(1, 5, 3, []))
    none = frame(spark, [])
    assert postings.top_k(none, some, 3).count() == 0 and postings.top_k(some, none, 3).count() == 0
    with pytest.raises(ValueError):
        postings.top_k(some, frame(spark, [(1, "a", ["t1"], [-1.0], "x")]), 3)


def test_pairs_stay_in_their_tasks(spark):
    """Every record shares a word with every query, and no bound rules one out: only the best of a task may leave it."""
    rng = np.random.default_rng(5)
    corpus = frame(spark, [(i, None, ["the"], [float(rng.integers(1, 50))], "x") for i in range(2000)])
    queries = frame(spark, [(5000 + i, None, ["the"], [1.0], "x") for i in range(10)])
    sizes, plain = [], postings._scored

    def spy(asked, lists, out):
        found = plain(asked, lists, out)
        sizes.append(found.count())
        return found

    postings._scored = spy
    try:
        got = rows_of(postings.top_k(queries, corpus, 3, hot_postings=100))
    finally:
        postings._scored = plain
    # 3 records and the query itself, for 10 queries in the tasks of 4 partitions; there are 20,000 pairs
    assert len(sizes) == 2 and max(sizes) <= 4 * 10 * 4
    assert got == rows_of(tiles.top_k(queries, corpus, SparseScorer(), 3, cells=(1, 2)))


def test_rows_of_one_id_are_summed_across_batches_and_blocks(spark):
    """A record in many rows counts once with all its weights, however small the blocks; rows without an id are never found."""
    rows = [(i % 7, None, ["a", "b"], [1.0, float(i % 7)], "x") for i in range(70)] + [(None, None, ["a"], [99.0], "x")]
    rows += [(3, None, ["a", "a", None], [0.5, 0.5, 7.0], "x"), (8, None, ["a", "b", "b"], [2.0, None], "x")]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = {hot: postings.top_k(frame(spark, [(100, None, ["a", "b"], [1.0, 1.0], "x")]), frame(spark, rows), 20, hot_postings=hot)
               .select("corpus_id", "score").distinct().collect() for hot in (1, 7, 1000)}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {i: 10.0 + 10.0 * i + (i == 3) for i in range(7)} | {8: 2.0}
    assert [{r["corpus_id"]: r["score"] for r in rows} for rows in got.values()] == [want] * 3


def test_documents_of_the_fit_are_tokenised_once(spark, monkeypatch):
    docs = spark.createDataFrame([("a", "one two two"), ("b", "two three"), ("c", None)], "id string, text string")
    calls, plain = [], lexical.counted
    monkeypatch.setattr(lexical, "counted", lambda *a: calls.append(a) or plain(*a))
    model = lexical.tfidf_fit(docs)
    once = lexical.tfidf_transform(docs, model)
    assert len(calls) == 1
    again = lexical.tfidf_transform(docs.select("id", "text"), model)
    assert len(calls) == 2 and sorted(once.collect()) == sorted(again.collect())
    # other stop words are another reading of the documents
    assert sum(len(r["terms"]) for r in lexical.tfidf_transform(docs, model, stop_words=["two"]).collect()) == 2
