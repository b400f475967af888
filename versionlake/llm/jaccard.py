"""Near duplicates: a Jaccard self-join on word shingles with rare-first prefix filtering."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import query, table, text_of, written

#: Words of a shingle and least similarity in percent, unless told otherwise.
WORDS = 5
PERCENT = 80
#: Ranges into which the suffix filter splits the hashes (a power of two), rows of a tile side, rows of small groups
#: that share a task.
RANGES = 128
TILE_ROWS = 1_000
BUCKET_ROWS = 10_000
#: Rows of related groups that a task takes together.
SHARE_ROWS = 100_000
#: Hubs of a token group before its remaining pairs are looked at.
HUB_ROUNDS = 2

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text; with fewer words, one hash of all; none without words."""
    # bytes.split() parts at the ASCII white space 0x20, 0x09-0x0D
    parts = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not parts:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    size = min(words, len(parts))
    count = len(parts) - size + 1
    mixed = np.full(count, np.uint64(size * 0x5851F42D4C957F2D % 2 ** 64))
    for i in range(size):
        mixed = (mixed ^ hashes[i:i + count]) * _MIX[0]
        mixed ^= mixed >> np.uint64(29)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX[1]
    mixed ^= mixed >> np.uint64(31)
    return np.unique(mixed)


def prefix_length(size: int, percent: int) -> int:
    """Two sets that link share an element among the first so many of either, in any order common to both."""
    return size - -(-percent * size // 100) + 1


def class_count(percent: int) -> int:
    """Hash classes of which the first alone has more elements than a prefix, but for small sets."""
    return max(1, 80 // max(1, 100 - percent))


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def sets_of(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """id, n, sig, n_first, tokens, ranges of every row. sig: a digest of the set, null if empty.

    tokens: the hashes of the first class and, where those are fewer than the prefix, as many as are missing from the
    other classes in order; n_first of the first class. Every row gives at least a prefix in the order (class, frequency
    within the first class, hash). ranges: numbers of hashes in equal ranges.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_of(docs, text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    classes = np.uint64(class_count(percent))

    def run(batches):
        for batch in batches:
            sizes, sigs, firsts, tokens, ranges = [], [], [], [], []
            for value in batch.column("text"):
                own = shingle_set(value.as_py(), words)
                n = len(own)
                sizes.append(n)
                sigs.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if n else None)
                group = own % classes
                first = own[group == 0]
                missing = prefix_length(n, percent) - len(first) if n else 0
                if missing > 0:
                    rest = own[group != 0]
                    rest = rest[np.argsort(group[group != 0], kind="stable")][:missing]
                    tokens.append(_signed(np.concatenate([first, rest])))
                else:
                    tokens.append(_signed(first))
                firsts.append(len(first))
                part = (own >> np.uint64(64 - RANGES.bit_length() + 1)).astype(np.int64)
                # cut off at a byte: the difference of two cut numbers is never more than that of the numbers
                ranges.append(np.minimum(np.bincount(part, minlength=RANGES), 255).astype(np.uint8).tobytes())
            lengths = np.cumsum([0, *map(len, tokens)]).astype(np.int32)
            flat = np.concatenate(tokens) if tokens else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()),
                 pa.array(firsts, pa.int64()), pa.ListArray.from_arrays(pa.array(lengths), pa.array(flat)),
                 pa.array(ranges, pa.binary())], ["id", "n", "sig", "n_first", "tokens", "ranges"])

    return rows.mapInArrow(run, f"id {kind}, n bigint, sig binary, n_first bigint, tokens array<bigint>, ranges binary")


def whole_sets(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """id and the whole set as ARRAY<BIGINT>."""
    rows = docs.select(F.col(id_col).alias("id"), text_of(docs, text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            sets = [_signed(shingle_set(v.as_py(), words)) for v in batch.column("text")]
            lengths = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.ListArray.from_arrays(pa.array(lengths), pa.array(flat))], ["id", "tokens"])

    return rows.mapInArrow(run, f"id {kind}, tokens array<bigint>")


def components(edges: DataFrame) -> DataFrame:
    """id and component (smallest id) of every end of `edges` (a, b), by alternating star contraction.

    Each round points every id's larger neighbours, then its smaller ones, at the smallest it knows. The edges never leave
    Spark; a written table ends each round, and the driver only learns whether anything changed.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: neighbours above an id join its smallest
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = large.distinct()
        # small star: an id and its smaller neighbours join the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
                 .unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        new = written(small)
        # done when every id has one edge, to an id that has none itself
        open_ids = new.groupBy("a").count().where("count > 1").select("a").unionByName(
            new.join(new.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a"))
        now = new
        if open_ids.isEmpty():
            break
    ends = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return ends.unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def _with_stars(links: DataFrame, labels: DataFrame | None) -> DataFrame:
    """New links and, for the components known before, one edge from each member to its name."""
    if labels is None:
        return links
    return links.unionByName(labels.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b")))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""
    left = sets.select(F.col("id").alias("a"), F.col("tokens").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("tokens").alias("y"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("x", "y"))
    return (both.select("a", "b", common.alias("common"), (F.size("x") + F.size("y")).alias("total"))
            .where(F.lit(100) * F.col("common") >= F.lit(percent) * (F.col("total") - F.col("common"))).select("a", "b"))


def _tile_pairs(percent: int):
    """Candidate pairs within a task: length, positional and suffix filters, for members of different components."""

    def pairs_of(side, ids, sizes, places, ranges, comps):
        """Index pairs of one group; of a tile between two chunks, only pairs across."""
        out = []
        order = np.argsort(sizes, kind="stable")
        for at, i in enumerate(order[:-1]):
            others = order[at + 1:]
            ok = (100 * sizes[i] >= percent * sizes[others]) & (comps[i] != comps[others]) & (ids[i] != ids[others])
            if side is not None:
                ok &= side[i] != side[others]
            others = others[ok]
            if not len(others):
                continue
            both = sizes[i] + sizes[others]
            # least overlap that links, and what the places of the common element leave
            need = -(-percent * both // (100 + percent))
            room = 1 + np.minimum(sizes[i] - places[i] - 1, sizes[others] - places[others] - 1)
            keep = room >= need
            others, both, need = others[keep], both[keep], need[keep]
            if not len(others):
                continue
            apart = np.abs(ranges[others] - ranges[i]).sum(axis=1, dtype=np.int64)
            out.append((i, others[apart <= both - 2 * need]))
        return out

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("token", "ascending"), ("id", "ascending")])
        token = group["token"].to_numpy()
        ids, sizes, places, comps = (group[c].to_numpy() for c in ("id", "n", "place", "component"))
        chunk = group["chunk"].to_numpy()
        ranges = np.frombuffer(b"".join(group["ranges"].to_pylist()), np.uint8).reshape(len(ids), -1).astype(np.int16)
        starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        a, b = [], []
        for lo, hi in zip(starts.tolist(), np.r_[starts[1:], len(token)].tolist()):
            part = slice(lo, hi)
            side = chunk[part] if len(np.unique(chunk[part])) > 1 else None
            for i, others in pairs_of(side, ids[part], sizes[part], places[part], ranges[part], comps[part]):
                a.append(np.full(len(others), ids[part][i]))
                b.append(ids[part][others])
        a = np.concatenate(a) if a else np.empty(0, np.int64)
        b = np.concatenate(b) if b else np.empty(0, np.int64)
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id of every row; rows link when 100 * common >= percent * union of their shingle sets.

    Shingles are `words` words, words are parted by ASCII white space and A-Z lower-cased; with fewer words the whole
    sequence is the one shingle. Without words or text a row links with nothing and is its own component. component_id is
    the smallest id reachable by links. Ids are integers that name one document each; repeated rows share a component. A
    null id takes the component of its copies, else null. An empty table gives no rows.

    1. Rows with equal sets are one class, named by its smallest id.
    2. Rare first: each class takes its prefix in the order (hash class, frequency among classes, hash). Frequencies are
       counted for the first hash class, a fixed share of all shingles which is larger than a prefix; shingles of one
       class only are counted as a place in the order and not joined.
    3. Classes that share a prefix shingle form a group. A group is first joined with hubs, one row a member, and the
       links found make components. Then the pairs within a group that still lie in different components pass the
       filters inside a task (groups beyond a tile are cut into pairs of chunks), and what is left is verified once.
       Pairs inside a component need no further look, as they can't change it; no other pair is left out.
    """
    sets = written(sets_of(docs, words, percent, id_col, text_col))
    # 1: one row a class; a class's name is the smallest id
    classes = written(sets.where("sig IS NOT NULL").groupBy("sig").agg(F.min("id").alias("id")))
    heads = sets.join(classes.where("id IS NOT NULL").select("id"), "id", "left_semi").where("sig IS NOT NULL")
    facts = sets.select("id", "n", "n_first", "ranges")

    # 2: frequency of prefix candidates over all classes
    placed = heads.select("id", F.explode("tokens").alias("token"))
    frequency = placed.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    shared = placed.join(frequency, "token")
    count = class_count(percent)
    # unsigned remainder of a signed 64-bit hash
    remainder = F.pmod(F.pmod(F.col("token"), F.lit(count)) + F.when(
        F.col("token") < 0, F.lit(2 ** 64 % count)).otherwise(F.lit(0)), F.lit(count))
    shared = shared.withColumn("later", (remainder != 0).cast("int"))
    shared = shared.join(facts.select("id", "n", "n_first").dropDuplicates(["id"]), "id")
    own = Window.partitionBy("id")
    order = own.orderBy("later", F.when(F.col("later") == 0, F.col("df")).otherwise(0), "token")
    shared = shared.withColumn("n_shared", F.sum(1 - F.col("later")).over(own)).withColumn(
        "rank", F.row_number().over(order))
    # shingles of one class only come before all shared ones of the first hash class
    alone = F.col("n_first") - F.col("n_shared")
    place = F.when(F.col("later") == 0, alone + F.col("rank") - 1).otherwise(F.col("n_first"))
    length = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / F.lit(100)) + 1
    prefix = shared.withColumn("place", place).where((F.col("later") == 1) | (F.col("place") < length))
    prefix = written(prefix.select("token", "id", "n", "place"))
    groups = prefix.groupBy("token").agg(F.count("*").alias("members")).where("members > 1")
    prefix = written(prefix.join(groups, "token"))

    # whole sets of the classes that have a candidate at all
    members = prefix.select("id").distinct()
    wanted = docs.join(members.withColumnRenamed("id", id_col), id_col, "left_semi")
    whole = written(whole_sets(wanted, words, id_col, text_col).dropDuplicates(["id"]))

    # 3a: hubs
    labels = None
    for turn in range(HUB_ROUNDS):
        now = prefix if labels is None else prefix.join(labels, "id", "left")
        now = now.withColumn("component", F.col("id") if labels is None else F.coalesce("component", "id"))
        hubs = now.groupBy("token").agg(F.min_by("id", F.xxhash64("id", "token", F.lit(turn))).alias("hub"))
        # the hub comes with its own size and component
        hubs = hubs.join(now.select(F.col("token"), F.col("id").alias("hub"), F.col("n").alias("hub_n"),
                                    F.col("component").alias("hub_component")), ["token", "hub"])
        pairs = now.join(hubs, "token").where(
            (F.col("component") != F.col("hub_component"))
            & (F.lit(100) * F.least("n", "hub_n") >= F.lit(percent) * F.greatest("n", "hub_n")))
        pairs = pairs.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
        labels = written(components(_with_stars(_verified(pairs, whole, percent), labels)))

    # 3b: what is left between components
    now = prefix.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = now.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("id").alias("low"),
                                     F.count("*").alias("rows")).where("lo <> hi")
    mixed = written(mixed.select("token", "low", "rows"))
    # groups with the same smallest member go to the same task, up to a bound, so that it drops a pair's repeats
    parts = mixed.groupBy("low").agg(F.ceil(F.sum("rows") / F.lit(SHARE_ROWS)).alias("parts"))
    mixed = mixed.join(parts, "low").select("token", F.xxhash64("low", F.pmod(
        F.xxhash64("token"), F.col("parts"))).alias("place_key"))
    now = now.join(mixed, "token").join(facts.select("id", "ranges").dropDuplicates(["id"]), "id")
    now = written(now)
    buckets = max(1, -(-now.count() // BUCKET_ROWS))
    chunks = F.ceil(F.col("members") / F.lit(TILE_ROWS)).cast("int")
    now = now.withColumn("chunks", chunks).withColumn(
        "chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    small = now.where("chunks = 1").select(
        F.pmod(F.col("place_key"), F.lit(buckets)).alias("key"), F.lit(-1).alias("i"), F.lit(-1).alias("j"), "token",
        "id", "n", "place", "component", "chunk", "ranges")
    # a group beyond a tile: each chunk meets itself and every other one, in a task for each two
    tiles = now.where("chunks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        F.col("place_key").alias("key"), F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "token",
        "id", "n", "place", "component", "chunk", "ranges")
    pairs = small.unionByName(tiles).groupBy("key", "i", "j").applyInArrow(_tile_pairs(percent), "a bigint, b bigint")
    found = _verified(written(pairs.distinct()), whole, percent)
    labels = components(_with_stars(found, labels))

    # copies take the component of their class; a class may hold a third of all rows, which the join may split
    named = classes.join(labels, "id", "left").select(
        "sig", F.coalesce("component", "id").alias("component_id"))
    out = sets.select("id", "n", "sig").join(named, "sig", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(
        F.col("sig").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


@query("op8_jaccard_join")
def op8_jaccard_join(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=85)
