"""The pipeline against a plain version over a small table with nulls, repeats, copies and clashing columns."""

import collections
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_operators import components_by_hand

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars int, id string, spans string, score double"
LABELS = "doc_id bigint, quality int, toxic int"
BAD = ["idiot", "moron", "scumbag"]
BLANKS = r"[\x20\x09-\x0D]+"


def corpus():
    """Texts by id; every sixth of the first 300 is toxic."""
    rng = np.random.default_rng(3)
    good = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    texts = []
    for i in range(300):
        words = list(rng.choice(good, 50))
        if i % 6 == 0:
            words.insert(3, BAD[i // 6 % 3])
        texts.append(" ".join(words))
    texts += [None, "", "  ", "write to some.one@example.org or +49 30 1234 5678 now", "at 192.168.0.1 and 4111 1111 1111 1111 ok"]
    texts += [texts[1], texts[1] + "  ", " ".join(texts[2].split()[:-2] + ["new", "end"]), " ".join(rng.choice(good, 6000))]
    return dict(enumerate(texts))


def write(spark, path, texts, labels):
    rows = [(i, t, "en", "s", len(t or ""), "x", "y", 0.5) for i, t in texts.items()]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{path}/labels.parquet")


def by_hand(texts):
    """Text by id of what stays, after toxicity, both kinds of copies, and masking."""
    kept = {i: t for i, t in texts.items() if not any(w in (t or "").split() for w in BAD)}
    groups = collections.defaultdict(list)
    for i, t in kept.items():
        groups[re.sub(BLANKS, "", t or "")].append(i)
    kept = {i: kept[i] for i in sorted(min(g, key=lambda i: (-len(kept[i] or ""), i)) for g in groups.values())}
    places = list(kept)
    found = components_by_hand(list(kept.values()), 5, 80)
    kept = {places[k]: kept[places[k]] for k, (_, component) in found.items() if k == component}
    marks = {"some.one@example.org": "<email>", "+49 30 1234 5678": "<phone>", "192.168.0.1": "<ip>", "4111 1111 1111 1111": "<card>"}
    for i, t in kept.items():
        for value, mark in marks.items():
            kept[i] = kept[i].replace(value, mark) if t else t
    return kept


def test_pipeline(spark, tmp_path):
    from tokenizers import Tokenizer

    texts = corpus()
    write(spark, str(tmp_path), texts, [(i, 1, int(i % 6 == 0)) for i in range(300)])
    kept = by_hand(texts)
    assert 300 not in kept or 301 not in kept
    pieces = collections.defaultdict(list)
    for p in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces[p["doc_id"]].append(p)
    assert set(pieces) == set(kept)
    model = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for i, text in kept.items():
        ids = np.array(model.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for p in sorted(pieces[i], key=lambda p: p["start"]):
            assert p["start"] == at and p["ids_crc32"] == zlib.crc32(ids[at:at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    path = str(tmp_path)
    write(spark, path, {}, [])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None, None, None, None), (1, None, "en", "s", 0, "x", "y", 0.5),
                                 (1, None, "en", "s", 0, "x", "y", 0.5), (None, "a b", "en", "s", 3, "x", "y", None)], DOCS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).count() == 0, name
        out = stage(spark, odd, path)
        assert out.columns == docs.columns and out.where(F.col("text") == "a b").count() == 1, name
    assert corpus_pipeline.run(spark, path).count() == 0


def test_drop_copies_keeps_the_same_of_repeated_rows(spark):
    rows = [(1, "ab", "en"), (1, " a b", "de"), (1, "a b ", "en"), (1, "a b ", "fr"), (2, "a  b  ", None), (2, "c", "en"),
            (None, None, "en"), (None, "", "en"), (3, "", None)]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id bigint, text string, lang string").repartition(3)
        got = sorted(map(tuple, corpus_pipeline.drop_copies(spark, docs, "").collect()), key=repr)
        assert got == sorted([(2, "a  b  ", None), (2, "c", "en"), (None, "", "en")], key=repr)
        one = docs.where("doc_id = 1")
        assert [tuple(r) for r in corpus_pipeline.drop_copies(spark, one, "").collect()] == [(1, "a b ", "fr")]
    assert corpus_pipeline.drop_copies(spark, docs.where("doc_id > 9"), "").count() == 0
