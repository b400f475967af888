"""Nearest neighbours by vantage-point trees, one a shard, with tunable pruning."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import query, table, written

#: Rows of a shard and of a query block, rows of a leaf, factor of the pruning (1 is exact).
SHARD_ROWS = 16_384
BLOCK_ROWS = 4_096
LEAF = 64
FACTOR = 1.25


def build_tree(vectors: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, list]:
    """Order of the rows and nodes (lo, hi, vantage row, inner max, outer min, left, right); leaves have vantage -1.

    A node's vantage row is far from the middle of its rows. Rows are split at the median place of their distances, so
    equal distances can't unbalance the tree; the bounds of both halves are kept and may touch.
    """
    order = np.arange(len(vectors))
    nodes: list = []
    todo = [(0, len(vectors), -1, 0)]
    while todo:
        lo, hi, parent, side = todo.pop()
        me = len(nodes)
        if parent >= 0:
            nodes[parent][5 + side] = me
        rows = order[lo:hi]
        if hi - lo <= leaf:
            nodes.append([lo, hi, -1, 0.0, 0.0, -1, -1])
            continue
        block = vectors[rows]
        vantage = rows[np.argmax(((block - block.mean(axis=0)) ** 2).sum(axis=1))]
        far = np.sqrt(((block - vectors[vantage]) ** 2).sum(axis=1))
        half = (hi - lo) // 2
        place = np.argpartition(far, half)
        order[lo:hi] = rows[place]
        nodes.append([lo, hi, int(vantage), float(far[place[:half]].max()), float(far[place[half:]].min()), -1, -1])
        todo += [(lo + half, hi, me, 1), (lo, lo + half, me, 0)]
    return order, nodes


def search_tree(ids: np.ndarray, vectors: np.ndarray, tree: tuple, q_ids: np.ndarray, queries: np.ndarray, k: int,
                factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest rows of each query, itself left out: (query place, row id, distance), ties to the smaller id.

    All queries walk the tree together. A half is skipped by the queries for which the least distance that the triangle
    inequality leaves, times `factor`, is beyond their k-th distance so far; at factor 1 no nearer row is skipped.
    """
    order, nodes = tree
    best = np.full((len(queries), k), np.inf)
    best_id = np.full((len(queries), k), np.iinfo(np.int64).max)
    todo = [(0, np.arange(len(queries)), np.zeros(len(queries)))]
    while todo:
        number, active, bound = todo.pop()
        # a bound equal to the k-th distance may hide a smaller id; rounding gets a margin
        active = active[bound * factor <= best[active, -1] * (1 + 1e-9) + 1e-12]
        if not len(active):
            continue
        lo, hi, vantage, inner, outer, left, right = nodes[number]
        if vantage < 0:
            rows = order[lo:hi]
            for at in range(0, len(active), 1024):
                part = active[at:at + 1024]
                gap = queries[part][:, None, :] - vectors[rows][None, :, :]
                far = np.sqrt(np.einsum("ijk,ijk->ij", gap, gap))
                names = np.broadcast_to(ids[rows], far.shape)
                far = np.where(names == q_ids[part][:, None], np.inf, far)
                far, names = np.hstack([best[part], far]), np.hstack([best_id[part], names])
                names = np.where(np.isinf(far), np.iinfo(np.int64).max, names)
                pick = np.lexsort((names, far), axis=1)[:, :k]
                best[part] = np.take_along_axis(far, pick, 1)
                best_id[part] = np.take_along_axis(names, pick, 1)
            continue
        far = np.sqrt(((queries[active] - vectors[vantage]) ** 2).sum(axis=1))
        near, away = np.maximum(far - inner, 0.0), np.maximum(outer - far, 0.0)
        middle = (inner + outer) / 2
        # the half that a query lies in comes first, so that its k-th distance shrinks early
        for first, second, inside in ((left, right, far <= middle), (right, left, far > middle)):
            sub = active[inside]
            if len(sub):
                near_sub, away_sub = near[inside], away[inside]
                own, other = (near_sub, away_sub) if first == left else (away_sub, near_sub)
                todo += [(second, sub, other), (first, sub, own)]
    place, slot = np.nonzero(np.isfinite(best))
    return place, best_id[place, slot], best[place, slot]


def usable(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, vector as doubles, dim; without vectors that are null, empty, zero or hold a null or non-finite component."""
    vector = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).alias("id"), vector.alias("vector")).where("id IS NOT NULL AND size(vector) > 0")
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return rows.where(~bad & F.exists("vector", lambda x: x != 0.0)).withColumn("dim", F.size("vector"))


def nearest(candidates: DataFrame, queries: DataFrame, k: int = 10, factor: float = FACTOR, id_col: str = "vec_id",
            vector_col: str = "embedding", shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest candidates found for each query, Euclidean distance in double precision.

    Candidates with the query's own id are left out. Every candidate row is indexed: rows are hashed into shards of about
    `shard_rows`, each with a tree of its own, and every block of queries visits every shard. Fewer than k rows come only
    where fewer candidates of the same width exist. Unusable vectors (see `usable`) take no part on either side; repeated
    candidate rows count each. Queries with the same id each have a list of their own, none of which holds that id. Ids
    are whole numbers; others are an error. Empty tables give no rows.
    """
    for side in (candidates, queries):
        if not isinstance(side.schema[id_col].dataType, T.IntegralType):
            raise TypeError(f"{id_col} must be of whole numbers, not {side.schema[id_col].dataType.simpleString()}")
    rows, asked = usable(candidates, id_col, vector_col), usable(queries, id_col, vector_col)
    shards = max(1, -(-candidates.count() // shard_rows))
    blocks = max(1, -(-queries.count() // block_rows))

    def packer(key: str):
        def run(group: pa.Table) -> pa.Table:
            vectors = group["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            ids = group["id"].to_numpy().astype("<i8")
            order = np.argsort(ids, kind="stable")
            width = group["dim"][0].as_py()
            vectors = np.ascontiguousarray(vectors.reshape(-1, width)[order], "<f8")
            out = {"dim": [width], key: [group[key][0].as_py()], "ids": [ids[order].tobytes()],
                   "vectors": [vectors.tobytes()]}
            kinds = {"dim": pa.int32(), key: pa.int64(), "ids": pa.binary(), "vectors": pa.binary()}
            if key == "shard":
                places, nodes = build_tree(vectors)
                out["places"] = [places.astype("<i8").tobytes()]
                out["nodes"] = [np.array(nodes, "<f8").tobytes()]
                kinds |= {"places": pa.binary(), "nodes": pa.binary()}
            return pa.table({c: pa.array(v, kinds[c]) for c, v in out.items()})
        return run

    def packed(df: DataFrame, key: str, parts: int) -> DataFrame:
        more = ", places binary, nodes binary" if key == "shard" else ""
        keyed = df.withColumn("id", F.col("id").cast("bigint")).withColumn(
            key, F.pmod(F.xxhash64("id"), F.lit(parts)))
        return keyed.groupBy("dim", key).applyInArrow(
            packer(key), f"dim int, {key} bigint, ids binary, vectors binary{more}")

    index = written(packed(rows, "shard", shards))
    lists = written(packed(asked, "block", blocks)).select(
        "dim", "block", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    # shards x blocks tiles, each of bounded size; a tile meets its shard by key
    tiles = lists.withColumn("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint"))))
    tiles = tiles.repartition(shards, "dim", "shard").join(index.repartition(shards, "dim", "shard"), ["dim", "shard"])

    def run(batches):
        for batch in batches:
            for tile in batch.to_pylist():
                width = tile["dim"]
                vectors = np.frombuffer(tile["vectors"], "<f8").reshape(-1, width)
                asked_ids = np.frombuffer(tile["q_ids"], "<i8")
                nodes = [[int(a), int(b), int(v), i, o, int(x), int(y)] for a, b, v, i, o, x, y in
                         np.frombuffer(tile["nodes"], "<f8").reshape(-1, 7).tolist()]
                place, found, far = search_tree(
                    np.frombuffer(tile["ids"], "<i8"), vectors, (np.frombuffer(tile["places"], "<i8"), nodes),
                    asked_ids, np.frombuffer(tile["q_vectors"], "<f8").reshape(-1, width), k, factor)
                n = len(place)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(asked_ids[place]), pa.array([width] * n, pa.int32()), pa.array([tile["block"]] * n, pa.int64()),
                     pa.array(np.asarray(place, np.int64)), pa.array(found), pa.array(far)],
                    ["query_id", "dim", "block", "place", "vec_id", "score"])

    found = tiles.mapInArrow(
        run, "query_id bigint, dim int, block bigint, place bigint, vec_id bigint, score double")
    # the place in its block tells a query from others with the same id
    order = Window.partitionBy("query_id", "dim", "block", "place").orderBy("score", "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


@query("op3_vptree")
def op3_vptree(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 100 = 0"))
