"""The Merkle manifest against a plain one."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F

from versionlake.llm import merkle

DOCS = "doc_id bigint, source string, lang string, n_chars int, text string, key string, rank int, root string"
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, tampered=False):
    text = row[4].translate(LOWER) if tampered and row[4] is not None else row[4]
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[1], row[2], row[3], text)))


def levels(nodes, run):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i:i + run]) for i in range(0, len(out[-1]), run)])
    return out


def siblings(tree, rank, run):
    out = []
    for nodes in tree[:-1]:
        lo = rank // run * run
        out.append((nodes[lo:rank], nodes[rank + 1:lo + run]))
        rank //= run
    return out


def plain(rows, run):
    """doc_id, leaf, subroot, root, proof, folded root, verified of every row."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees, members = [], []
    for s in sources:
        own = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        members.append(own)
        trees.append(levels([leaf(r) for r in own], run))
    top = levels([t[-1][0] for t in trees], run)
    out = []
    for s, (tree, own) in enumerate(zip(trees, members)):
        for rank, row in enumerate(own):
            path = siblings(tree, rank, run) + siblings(top, s, run)
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            folded = leaf(row, tampered)
            for before, after in path:
                folded = H(*before, folded, *after)
            out.append((row[0], leaf(row), tree[-1][0], top[-1][0],
                        H(*(d for before, after in path for d in before + after)), folded, folded == top[-1][0]))
    return out


def rows_of():
    rng = random.Random(5)
    texts = ["", None, "Plain text", "lower only", "ÀÉ Σ 中 A", "x" * 200_000 + "Q", "UPPER"]
    rows = [(i, "hot", rng.choice(["en", None]), rng.choice([3, None]), rng.choice(texts)) for i in range(290)]
    rows += [(i, rng.choice([None, "", "a", "é", "\U0001f600", "b,c"]), "de", 7, rng.choice(texts)) for i in range(290, 340)]
    rows += [(i, f"s{i}", "fr", 1, "Some Text") for i in range(400, 420)]       # sources of one leaf
    rows += [(i, "s16", None, None, "T") for i in range(500, 516)] + [(i, "s17", None, None, "T") for i in range(520, 537)]
    rows += [(5, "hot", "en", 3, "other"), (7, "hot", "en", 3, "again"), (7, "hot", "en", 3, "again"), (None, "hot", None, 1, "N"),
             (None, None, None, None, None), (-3, "a", "x", -1, "Neg")]
    rng.shuffle(rows)
    return rows


def collected(df):
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)


def test_manifest_equals_a_plain_tree(spark):
    rows = rows_of()
    docs = spark.createDataFrame([(*r, "k", 1, "r") for r in rows], DOCS).repartition(5)
    for bits in (4, 1):
        want = sorted(plain(rows, 2 ** bits), key=repr)
        assert collected(merkle.audited(docs, bits)) == want
    assert {w[-1] for w in want} == {True, False}


def test_manifest_of_one_row_and_of_none(spark):
    one = [(0, None, None, None, "Text")]
    docs = spark.createDataFrame([(*r, "k", 1, "r") for r in one], DOCS)
    assert collected(merkle.audited(docs)) == plain(one, 16)
    assert plain(one, 16)[0][4] == H() and collected(merkle.audited(docs.limit(0))) == []


def test_some_requests_get_the_proofs_of_all(spark):
    docs = spark.createDataFrame([(*r, "k", 1, "r") for r in rows_of()], DOCS)
    leaves = docs.select("doc_id", "source", merkle.leaf_of(F.col("doc_id"), F.col("text")).alias("leaf"))
    found = merkle.build_manifest(leaves, "source", ["doc_id"])
    def facts(df):
        return {(r["key"], r["rank"]): (bytes(r["leaf"]), r["folded"], r["proof"]) for r in df.select(
            "key", "rank", "leaf", merkle.fold(F.col("leaf"), F.col("path")).alias("folded"),
            merkle.siblings_digest(F.col("path")).alias("proof")).collect()}
    everything = facts(merkle.prove(found))
    some = facts(merkle.prove(found, found.leaves.where("doc_id % 7 = 3 or source is null")))
    assert 0 < len(some) < len(everything) == docs.count()
    assert all(everything[k] == v for k, v in some.items())
    assert {v[1] for v in everything.values()} == {found.root.hex()}
    # a record is found by the digest of its children
    for height, records in found.inner.records.items():
        for r in records.collect():
            assert H(*(bytes(c).hex() for c in r["children"])) == bytes(r["digest"]).hex()


def test_registered_query(spark, tmp_path):
    rows = rows_of()
    spark.createDataFrame([(*r, "k", 1, "r") for r in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert collected(merkle.op13_merkle(spark, str(tmp_path))) == sorted(plain(rows, 16), key=repr)
