import collections
import math
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from versionlake.functions import text as X
from versionlake.operators import lexical, transcripts as T


@pytest.mark.parametrize("given, expected", [
    ("la la la la", "la la"), ("la la la", "la la la"), ("Oh oh oh oh my", "Oh my"),
    ("no, no, no, no, yes", "no yes"), ("oh Thank you.", "oh Thank you."), ("Thank you.x go", "x go"),
    ("play music now", "play  now"), ("é é é é fin", "é fin"),
])
def test_cleaning(spark, given, expected):
    df = spark.createDataFrame([(given,)], "t string")
    cleaned = X.collapse_repeats(X.remove_phrases(F.col("t"), ["Thank you.", "music"]))
    assert df.select(cleaned).first()[0] == expected


def test_collapse_against_python(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["la", "LA", "é", "x"]) + rng.choice([" ", ", ", "  "]) for _ in range(12)) for _ in range(200)]
    pattern = re.compile(r"\b(\w+)[,\s]+(?:\1\b[,\s]+){2,}", re.IGNORECASE)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r["t"]: r["c"] for r in df.select("t", X.collapse_repeats(F.col("t")).alias("c")).collect()}
    assert all(got[t] == pattern.sub(r"\1 ", t) for t in texts)


def brute_edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_edit_distance_and_lcs_against_tables():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.choice("abcd") for _ in range(rng.randrange(0, 90))]
        b = [rng.choice("abcd") for _ in range(rng.randrange(0, 90))]
        assert X.edit_distance(a, b) == brute_edit(a, b)
        assert X.lcs_length(a, b) == brute_lcs(a, b)


def test_word_error_rate(spark):
    df = spark.createDataFrame([(" The cat sat on mats", "the cat SAT mat"), (None, "x"), ("a", None)], "r string, h string")
    got = [r["wer"] for r in T.word_errors(df, "r", "h").collect()]
    assert got == [pytest.approx(2 / 5), None, None]


def test_chunks_cover_the_text():
    rng = random.Random(5)
    text = "\n\n".join("\n".join(" ".join("w" * rng.randrange(1, 12) for _ in range(rng.randrange(1, 60))) for _ in range(3)) for _ in range(5))
    text += "\n\n" + "z" * 450
    pieces = X.chunk_text(text, 200)
    assert max(map(len, pieces)) <= 200
    assert re.sub(r"\s", "", "".join(pieces)) == re.sub(r"\s", "", text)
    assert X.chunk_text("a b", 200) == ["a b"] and X.chunk_text("  ", 200) == []


def test_regroup(spark):
    rows = [("a", 1, "one two three four"), ("a", 0, "no"), ("a", 2, "five six seven eight nine")]
    df = T.clean_chunks(spark.createDataFrame(rows, "md5_encoded string, chunk_id int, text string"))
    tracks = spark.createDataFrame([("a",), ("b",)], "md5_encoded string")
    got = {r["md5_encoded"]: r for r in T.regroup_text(df, tracks=tracks).collect()}
    assert got["a"]["texts"] == ["", "one two three four", "five six seven eight nine"]
    assert got["a"]["mask"] == [False, True, True]
    assert got["a"]["joined"] == "one two three four\n\nfive six seven eight nine"
    assert got["b"]["texts"] == [] and got["b"]["joined"] == ""


def test_bleu_and_rouge(spark):
    same = "the quick brown fox jumps over the dog".split()
    df = spark.createDataFrame([(1, same, same), (2, same[:3], same), (3, same[:5], same)], "k int, c array<string>, r array<string>")
    got = {r["k"]: r["bleu"] for r in T.bleu(df, "k", "c", "r").collect()}
    assert got[1] == pytest.approx(1.0) and got[2] == 0.0 and got[3] == pytest.approx(2.718281828 ** (1 - 8 / 5))
    rouge = {r["k"]: r["v"] for r in df.select("k", X.rouge_l(F.col("c"), F.col("r")).alias("v")).collect()}
    assert rouge[1] == 1.0 and rouge[2] == pytest.approx(2 * 3 / 11)
    plural = df.where("k = 1").select(F.transform("c", lambda t: F.concat(t, F.lit("s"))).alias("c"), "r")
    stem = plural.select(X.rouge_l(F.col("c"), F.col("r")).alias("plain"),
                         X.rouge_l(F.col("c"), F.col("r"), lambda t: F.regexp_replace(t, "s+$", "")).alias("v")).first()
    assert stem["plain"] == 0.0 and stem["v"] == 1.0


def test_correlation_p_value():
    from versionlake.functions.stats import pearson_p_value
    assert pearson_p_value(0.5, 10) == pytest.approx(0.14111, abs=1e-4)
    assert pearson_p_value(0.0, 30) == pytest.approx(1.0)
    assert pearson_p_value(None, 3) is None


def test_bleu_counts_inside_the_row(spark):
    """No n-gram is shuffled where keys are distinct; rows of one key are counted together; a null key has 0."""
    rng = random.Random(4)
    rows = [(i, [rng.choice("abcd") for _ in range(rng.randint(0, 30))], [rng.choice("abcd") for _ in range(rng.randint(0, 30))])
            for i in range(80)] + [(100, None, ["a"] * 5), (101, ["a"] * 5, None), (102, [], []), (None, ["a"] * 5, ["a"] * 5)]
    schema = "k int, c array<string>, r array<string>"

    def by_hand(pairs, c, r):
        if not c:
            return 0.0
        logs = 0.0
        for n in range(1, 5):
            left, right = (collections.Counter(tuple(p[side][i:i + n]) for p in pairs
                                               for i in range(len(p[side] or []) - n + 1)) for side in (0, 1))
            hits = sum(min(v, right[g]) for g, v in left.items())
            if not hits:
                return 0.0
            logs += math.log(hits / sum(left.values()))
        return min(1.0, math.exp(1 - len(r) / len(c)) if len(c) <= len(r) else 1.0) * math.exp(logs / 4)

    one = T.bleu(spark.createDataFrame(rows, schema), "k", "c", "r")
    assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()
    got = {r["k"]: r["bleu"] for r in one.collect()}
    assert got[None] == 0.0
    assert got == pytest.approx({k: 0.0 if k is None else by_hand([(c, r)], c, r) for k, c, r in rows})
    assert sum(v > 0 for v in got.values()) > 20
    twice = rows[:40] + [(k, r, c) for k, c, r in rows[:20]]
    got = sorted((r["k"], round(r["bleu"], 9)) for r in T.bleu(spark.createDataFrame(twice, schema), "k", "c", "r").collect())
    want = sorted((k, round(by_hand([(x, y) for j, x, y in twice if j == k], c, r), 9)) for k, c, r in twice)
    assert [k for k, _ in got] == [k for k, _ in want] and [v for _, v in got] == pytest.approx([v for _, v in want], abs=2e-9)


def test_pair_cosine_inside_the_row(spark):
    rng = random.Random(8)
    vectors = {f"d{i}": {t: rng.random() for t in rng.sample("abcdefghij", rng.randint(0, 4))} for i in range(40)}
    rows = [(k, list(v), list(v.values())) for k, v in vectors.items()]
    df = spark.createDataFrame(rows, "id string, terms array<string>, weights array<double>")
    pairs = [(f"d{rng.randint(0, 45)}", f"d{rng.randint(0, 45)}") for _ in range(300)]
    want = collections.Counter()
    for q, c in pairs:
        for t in vectors.get(q, {}).keys() & vectors.get(c, {}).keys():
            want[q, c] += vectors[q][t] * vectors[c][t]
    out = lexical.pair_cosine(spark.createDataFrame(pairs, "query_id string, corpus_id string"), df)
    assert {(r[0], r[1]): r[2] for r in out.collect()} == pytest.approx(dict(want))
    # terms travel inside vectors: none is a row of its own
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()


def test_terms_are_counted_few_texts_at_a_time():
    texts = pa.record_batch({"id": list(range(1000)), "text": [f"one two two w{i}" for i in range(1000)]})
    found = list(X.term_counter()([texts]))
    assert max(b.num_rows for b in found) <= 256 and sum(b.num_rows for b in found) == 1000
    last = found[-1].to_pylist()[-1]
    assert last == {"id": 999, "terms": ["one", "two", "w999"], "counts": [1, 2, 1], "n_tokens": 4}
