"""Merkle manifest of a dataset: a content-addressed tree of digests, proofs by descent from its root."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import crc32_sql, in_order, query, ranked, table, written

#: Bits of a rank digit: 2 ** BITS consecutive nodes become one.
BITS = 4


def digest_of(content: Column) -> Column:
    """The digest H of a string as 32 bytes."""
    return F.unhex(F.sha2(content.cast("binary"), 256))


def hex_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def field_of(value: Column) -> Column:
    """`-` for null, else UTF-8 byte count, a colon and the value; integers decimal."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*values: Column) -> Column:
    return digest_of(F.concat(*map(field_of, values)))


@dataclass
class Tree:
    """Digest-to-children records by height, and the root of every key: key, n (leaves), digest."""
    records: dict[int, DataFrame]
    roots: DataFrame


@dataclass
class Manifest:
    """leaves: the caller's columns with key, rank and n. groups: key and its rank among all keys.

    `inner` holds a tree a key, `outer` the one tree over their roots; `root` is its digest, None without leaves.
    """
    leaves: DataFrame
    groups: DataFrame
    inner: Tree
    outer: Tree
    root: bytes | None


def build_tree(nodes: DataFrame, bits: int = BITS) -> Tree:
    """The tree over `nodes` (key, rank, n, digest) of each key.

    While a key has several nodes, every 2 ** bits consecutive ones become the digest of their hex digests. A level is
    one aggregation on (key, rank of the parent), so a hot key is spread over all tasks. Each level is written.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    left = nodes.select("key", "rank", "n", "digest")
    records, roots = {}, left.where("n = 1").select("key", "n", "digest")
    height = 0
    while most > 1:
        height += 1
        most = -(-most >> bits)
        # keys whose nodes below this level are more than one
        open_nodes = left.where(F.shiftright(F.col("n") - 1, bits * (height - 1)) > 0)
        runs = open_nodes.groupBy("key", "n", F.shiftright("rank", bits).alias("rank")).agg(
            F.sort_array(F.collect_list(F.struct("rank", "digest")))["digest"].alias("children"))
        content = F.array_join(F.transform("children", hex_of), "")
        level = written(runs.withColumn("digest", digest_of(content)))
        records[height] = level
        left = level.select("key", "rank", "n", "digest")
        roots = roots.unionByName(left.where(
            F.shiftright(F.col("n") - 1, bits * height) == 0).select("key", "n", "digest"))
    return Tree(records, roots)


def build_manifest(leaves: DataFrame, group_col: str, order: list[str], bits: int = BITS) -> Manifest:
    """The manifest of `leaves`, which have a column `leaf` (32 bytes) next to the caller's own.

    Leaves of a group ascend by `order`, nulls first, then by digest. The roots of the groups, ordered by group (null
    first, UTF-8 bytewise), are the leaves of the outer tree. Repeated rows are leaves of their own. Without rows there is
    no root. The caller's columns must not be called key, rank, n or begin with two underscores.
    """
    # null sorts before every other key, and an empty group after it
    key = F.when(F.col(group_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group_col).cast("string")))
    # hashed once: dealing by ranges reads its input twice
    numbered = written(ranked(in_order(written(leaves.withColumn("key", key)), "key", [*order, "leaf"])))
    inner = build_tree(numbered.withColumnRenamed("leaf", "digest"), bits)
    subroots = inner.roots.select(F.lit("").alias("key"), F.col("key").alias("group"), "digest")
    groups = written(ranked(in_order(subroots, "key", ["group"])))
    outer = build_tree(groups, bits)
    root = outer.roots.first()
    return Manifest(numbered, groups, inner, outer, bytes(root["digest"]) if root else None)


def _sides(children: Column, digit: Column) -> Column:
    """The digests before and after the selected child, each side joined to one binary."""
    def joined(part: Column) -> Column:
        return F.unhex(F.array_join(F.transform(part, F.hex), ""))
    return F.struct(joined(F.slice(children, F.lit(1), digit)).alias("before"),
                    joined(F.slice(children, digit + 2, F.size(children))).alias("after"))


def _descend(starts: DataFrame, requests: DataFrame, tree: Tree, bits: int) -> DataFrame:
    """`requests` (key, rank, ...) with the path segments from the root of their key to their leaf.

    `starts` has key, n, digest and segments (array of before and after) of each root, and columns of the caller.
    Requests that share rank digits descend as one until they part: what goes from level to level is one row an open
    node. A node is looked up by its digest; each requested child goes on with the unselected children as a new segment.
    A request joins its path at the lowest node, so nothing with a proof in it is shuffled once a leaf.
    """
    own = [c for c in starts.columns if c not in ("key", "n", "digest", "segments")]
    wanted = {}
    for height in sorted(tree.records):
        if height > 1:
            source = wanted[height - 1] if height > 2 else requests.select("key", F.shiftright("rank", bits).alias("rank"))
            wanted[height] = source.select("key", F.shiftright("rank", bits).alias("rank")).distinct()
    lone = requests.where("n = 1").join(starts.drop("n", "digest"), "key")
    front = None
    for height in sorted(tree.records, reverse=True):
        above = F.shiftright(F.col("n") - 1, bits * height)
        below = F.shiftright(F.col("n") - 1, bits * (height - 1))
        here = starts.where((above == 0) & (below > 0)).withColumn("rank", F.lit(0).cast("bigint"))
        here = here if front is None else here.unionByName(front)
        store = tree.records[height].select("digest", "children").dropDuplicates(["digest"])
        if height > 1:
            here = here.join(wanted[height], ["key", "rank"], "left_semi")
        opened = here.join(store, "digest")
        if height == 1:
            lowest = opened.select("key", F.col("rank").alias("parent"), "segments", "children", *own)
            asked = requests.where("n > 1").withColumn("parent", F.shiftright("rank", bits))
            digit = F.col("rank").bitwiseAND(2 ** bits - 1).cast("int")
            found = asked.join(lowest, ["key", "parent"]).withColumn(
                "segments", F.concat("segments", F.array(_sides(F.col("children"), digit))))
            return lone.unionByName(found.drop("parent", "children").select(*lone.columns))
        child = opened.select("key", "n", "rank", "segments", "children", *own, F.posexplode("children").alias("digit", "digest"))
        front = child.select("key", "n", "digest", F.concat("segments", F.array(
            _sides(F.col("children"), F.col("digit")))).alias("segments"), *own,
            (F.shiftleft("rank", bits) + F.col("digit")).alias("rank"))
    return lone


def prove(found: Manifest, requests: DataFrame | None = None, bits: int = BITS) -> DataFrame:
    """Adds subroot, root and path to the requested leaves (rows of `found.leaves`; all unless told otherwise).

    path is an array of the digests `before` and `after` the node, as joined bytes, from the leaf to the root.
    """
    nothing = F.array().cast("array<struct<before:binary,after:binary>>")
    requests = found.leaves if requests is None else requests
    tops = found.outer.roots.withColumn("segments", nothing)
    keys = found.groups.select("key", "rank", "n", "group", F.col("digest").alias("subroot"))
    starts = _descend(tops, keys, found.outer, bits).select(F.col("group").alias("key"), "subroot", "segments")
    starts = written(starts.join(found.inner.roots, "key"))
    paths = _descend(starts, requests, found.inner, bits)
    return paths.withColumn("path", F.reverse("segments")).withColumn("root", F.lit(found.root)).drop("segments")


def fold(leaf: Column, path: Column) -> Column:
    """The root in hex that a leaf (32 bytes) and its siblings give."""
    def step(below: Column, s: Column) -> Column:
        return F.sha2(F.concat(hex_of(s["before"]), below, hex_of(s["after"])).cast("binary"), 256)
    return F.aggregate(path, hex_of(leaf), step)


def siblings_digest(path: Column) -> Column:
    """H in hex of all siblings, level by level from the leaf to the root, left to right."""
    joined = F.array_join(F.transform(path, lambda s: F.concat(hex_of(s["before"]), hex_of(s["after"]))), "")
    return F.sha2(joined.cast("binary"), 256)


def audited(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """Leaf, subroot, root, proof and verification of every row of documents; where 5 divides the unsigned crc32 of the
    decimal doc_id, what is verified is a row whose text has its A-Z lower-cased.

    Nulls in any column are `-`; a null doc_id comes first in its source and is not tampered with. Empty and very long
    texts are hashed whole. Rows with equal ids are ordered by their digests. Columns beyond the five are ignored. An empty
    table gives no rows.
    """
    head = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    leaves = docs.select("doc_id", "source", leaf_of(*head, F.col("text")).alias("leaf"),
                         F.when(hit, leaf_of(*head, lowered)).alias("tampered"))
    proofs = prove(build_manifest(leaves, "source", ["doc_id"], bits), bits=bits)
    out = proofs.select("doc_id", hex_of(F.col("leaf")).alias("leaf"), hex_of(F.col("subroot")).alias("subroot"),
                        hex_of(F.col("root")).alias("root"), siblings_digest(F.col("path")).alias("proof_sha256"),
                        fold(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _field_sql(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR)::VARCHAR || ':' || {column}::VARCHAR, '-')"


_HEAD = " || ".join(map(_field_sql, ("doc_id", "source", "lang", "n_chars")))
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_UP = ("list_transform(range(0, (len(l) + 15) // 16), "
       "lambda i: sha256(array_to_string(l[i * 16 + 1:i * 16 + 16], '')))")
SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, sha256({_HEAD} || {_field_sql('text')}) AS leaf,
         CASE WHEN {crc32_sql('doc_id::VARCHAR')} % 5 = 0 THEN sha256({_HEAD} || {_field_sql(_LOWERED)}) END AS tampered
  FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r,
             row_number() OVER () AS id FROM d),
inner_levels AS (
  SELECT source, 0 AS k, list(leaf ORDER BY r) AS l FROM r GROUP BY source
  UNION ALL SELECT source, k + 1, {_UP} FROM inner_levels WHERE len(l) > 1),
subs AS (SELECT source, l[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS s
         FROM inner_levels WHERE len(l) = 1),
outer_levels AS (
  SELECT 0 AS k, list(subroot ORDER BY s) AS l FROM subs
  UNION ALL SELECT k + 1, {_UP} FROM outer_levels WHERE len(l) > 1),
spots AS (
  SELECT id, k, l, r >> (4 * k) AS p FROM r JOIN inner_levels i ON r.source IS NOT DISTINCT FROM i.source WHERE len(l) > 1
  UNION ALL
  SELECT id, 100 + k, l, s >> (4 * k) FROM r JOIN subs ON r.source IS NOT DISTINCT FROM subs.source, outer_levels
  WHERE len(l) > 1),
sides AS (SELECT id, k, array_to_string(l[p // 16 * 16 + 1:p], '') AS before,
                 array_to_string(l[p + 2:p // 16 * 16 + 16], '') AS after FROM spots),
paths AS (SELECT id, list(before || '|' || after ORDER BY k) AS path,
                 string_agg(before || after, '' ORDER BY k) AS siblings FROM sides GROUP BY id),
folded AS (
  SELECT doc_id, leaf, subroot, (SELECT l[1] FROM outer_levels WHERE len(l) = 1) AS root,
         sha256(coalesce(siblings, '')) AS proof_sha256,
         list_reduce([coalesce(tampered, leaf)] || coalesce(path, []),
                     lambda a, x: sha256(split_part(x, '|', 1) || a || split_part(x, '|', 2))) AS folded_root
  FROM r LEFT JOIN paths USING (id) JOIN subs ON r.source IS NOT DISTINCT FROM subs.source)
SELECT *, folded_root = root AS verified FROM folded
"""


@query("op13_merkle", SQL)
def op13_merkle(spark, sf_dir):
    return audited(table(spark, sf_dir, "documents"))
