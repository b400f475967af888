"""Benchmark decontamination against a plain search."""

import hashlib
import random
import re

from versionlake.llm import decontam as D

DOCS = "doc_id bigint, text string, row bigint, words string, token int, items string"
ITEMS = "item_id bigint, text string, doc_id int, n int"
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def plain(docs, items, window=10):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[s:s + n]), set()).add("" if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for s in range(len(w) - n + 1):
                if tuple(w[s:s + n]) in windows:
                    hit.update(range(s, s + n))
                    found |= windows[tuple(w[s:s + n])]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def tables():
    rng = random.Random(8)
    vocabulary = ["the", "of", "a", "to", "in", "is", "Ça", "中文", "x1", "42", "Lorem", "IPSUM", "dolor"]

    def prose(n):
        return " ".join(rng.choice(vocabulary) + rng.choice(["", "", ".", "! -", "\n"]) for _ in range(n))
    items = [(i, prose(rng.randint(10, 40))) for i in range(20)]
    shared = prose(14)
    items += [(20, shared), (21, shared), (22, prose(3) + " " + shared), (23, "the of a"), (24, "rareword"), (25, ""), (26, None),
              (27, "... !"), (None, prose(12)), (20, shared), (20, prose(11)), (2, prose(9)), (28, "a b c d e f g h i j " * 40)]
    docs = [(i, prose(rng.randint(0, 80))) for i in range(60)]
    docs += [(100 + i, f"{prose(rng.randint(0, 12))} {items[rng.randrange(len(items))][1] or ''} {prose(rng.randint(0, 12))}")
             for i in range(60)]
    docs += [(200 + i, f"{shared} {i}") for i in range(50)]                          # a passage of many documents
    docs += [(300, items[0][1]), (301, " ".join(items[0][1].split()[:9])), (302, " ".join(items[0][1].split()[-10:])),
             (303, None), (304, ""), (305, "RareWord"), (306, "x " * 40_000 + shared.upper() + " y" * 40_000),
             (307, "j a b c d e f g h i j a b"), (None, shared), (300, "other text"), (300, items[0][1])]
    rng.shuffle(docs)
    return docs, items


def collected(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"))
                   for r in df.collect()), key=repr)


def write(spark, folder, docs, items):
    spark.createDataFrame([(*d, 1, "w", 2, "i") for d in docs], DOCS).repartition(5).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(*i, 1, 2) for i in items], ITEMS).write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_registered_query(spark, tmp_path):
    docs, items = tables()
    want = plain(docs, items)
    assert collected(D.op11_decontaminate(spark, write(spark, tmp_path, docs, items))) == want
    assert 50 < sum(r[-1] for r in want) < len(want)


def test_salted_tokens_and_a_full_filter_give_the_same(spark, tmp_path, monkeypatch):
    docs, items = tables()
    folder = write(spark, tmp_path, docs, items)
    monkeypatch.setattr(D, "MOST_BITS", 16)                # many other tokens pass
    monkeypatch.setattr(D, "BITS_A_TOKEN", 1)
    monkeypatch.setattr(D.leaks, "__defaults__", (*D.leaks.__defaults__[:-1], 3))   # every token of four hits is salted
    assert collected(D.op11_decontaminate(spark, folder)) == plain(docs, items)


def test_spans_and_other_sizes(spark):
    docs, items = tables()
    left = spark.createDataFrame([(*d, 1, "w", 2, "i") for d in docs], DOCS)
    right = spark.createDataFrame([(*i, 1, 2) for i in items], ITEMS)
    for window, shingle in ((6, 5), (4, 7), (3, 1)):
        got = D.leaks(left, right, window, shingle).collect()
        flat = sorted(((r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["items"]))
                       for r in got), key=repr)
        assert flat == sorted(((r[:4]) for r in plain(docs, items, window)), key=repr)
        for r in got:
            ends = [(s["start"], s["end"]) for s in r["spans"]]
            assert all(a < b for a, b in ends) and all(x[1] < y[0] for x, y in zip(ends, ends[1:]))


def test_empty_tables(spark, tmp_path):
    docs, items = tables()
    folder = write(spark, tmp_path / "none", docs, [])
    assert collected(D.op11_decontaminate(spark, folder)) == plain(docs, [])
    folder = write(spark, tmp_path / "empty", [], items)
    assert D.op11_decontaminate(spark, folder).count() == 0
