"""Vector tables: pooling, paired similarity, projections, in-batch reports and frame alignment.

An embedding table has one row a chunk: id, chunk_id, embedding.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from versionlake.functions import vectors as V
from versionlake.functions.scorers import FrameShiftScorer, list_matrix, score_block
from versionlake.functions.seeded import seeded_hash
from versionlake.operators import tiles
from versionlake.session import reliable_checkpoint


def _vector(column: str):
    return array_to_vector(V.as_double(F.col(column)))


def mean_pool(chunks: DataFrame, key: str | list[str] = "id", column: str = "embedding") -> DataFrame:
    """Mean vector per id, not normalised again. A partial aggregate, so a huge id costs no single task.

    Null and empty vectors (failed items of an encoder) are left out; an id with nothing else gives no row.
    """
    keys = [key] if isinstance(key, str) else key
    return (chunks.where(F.size(column) > 0).groupBy(*keys).agg(Summarizer.mean(_vector(column)).alias("_m"))
            .select(*keys, vector_to_array("_m").alias(column)))


def stack_chunks(chunks: DataFrame, key: str = "id", order: str = "chunk_id", column: str = "embedding",
                 out: str = "vectors") -> DataFrame:
    """All vectors of an id as one array, in chunk order: the input of multi-vector scorers."""
    rows = chunks.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(
        F.col(order).alias("o"), F.col(column).alias("e")))).alias("_v"))
    return rows.select(key, F.transform("_v", lambda x: x["e"]).alias(out))


# ---------------------------------------------------------------- paired sets

def paired_cosine(left: DataFrame, right: DataFrame, key: str = "id", column: str = "embedding") -> DataFrame:
    """Cosine of the two vectors of every id present in both sets: key, score."""
    b = right.select(key, F.col(column).alias("_other"))
    return left.select(key, column).join(b, key).select(
        key, V.cosine(F.col(column), F.col("_other")).alias("score"))


def paired_summary(scores: DataFrame) -> DataFrame:
    """Mean and population deviation of paired scores, with their number."""
    return scores.agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.count("*").alias("n"))


def mismatched(scores: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Ids whose two vectors disagree (score below the threshold)."""
    return scores.where(F.col("score") < threshold)


def histogram(scores: DataFrame, column: str = "score", bins: int = 20) -> DataFrame:
    """Counts of equal-width bins over the range of the column; the last bin includes the maximum.
    bin (1-based), low, high, n; empty bins are present."""
    low, high = scores.agg(F.min(column), F.max(column)).first()
    if low is None:
        low, high = 0.0, 1.0
    if low == high:
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    place = F.least(F.floor((F.col(column) - low) / width) + 1, F.lit(bins)).cast("int")
    counts = scores.groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    edges = (scores.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
             .withColumns({"low": low + (F.col("bin") - 1) * width, "high": low + F.col("bin") * width}))
    return edges.join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def aggregate_pairs(left: DataFrame, right: DataFrame, key: str = "version_id", column: str = "embedding",
                    min_chunks: int = 2) -> DataFrame:
    """Mean vectors of both sets for ids with at least `min_chunks` chunks on the left:
    key, embedding_a, embedding_b. An id without vectors on the right is an error."""
    enough = left.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= min_chunks).select(key)
    absent = enough.join(right.select(key).distinct(), key, "left_anti").limit(1)
    if not absent.isEmpty():
        raise ValueError("some ids have no vectors in the second set")
    a = mean_pool(left.join(enough, key, "left_semi"), key, column).withColumnRenamed(column, "embedding_a")
    b = mean_pool(right.join(enough, key, "left_semi"), key, column).withColumnRenamed(column, "embedding_b")
    return a.join(b, key)


def aligned_segments(left: DataFrame, right: DataFrame, key: str = "uid") -> DataFrame:
    """Rows of both sets with a common id, in id order; nothing in common is an error."""
    both = left.select(key, F.col("embedding").alias("embedding_a")).join(
        right.select(key, F.col("embedding").alias("embedding_b")), key)
    if both.limit(1).isEmpty():
        raise ValueError("the two sets have no common id")
    return both.orderBy(key)


# ---------------------------------------------------------------- projection and spread

def pca_pairs(pairs: DataFrame, key: str, sample: int | None = None, seed: int = 42, k: int = 2) -> DataFrame:
    """k-dimensional PCA of both vectors of each pair, stacked: key, side, components.
    Component signs are set so that the largest loading is positive."""
    if sample is not None:
        pairs = pairs.orderBy(seeded_hash(seed, key)).limit(sample)
    stacked = pairs.select(key, F.explode(F.array(
        F.struct(F.lit("a").alias("side"), F.col("embedding_a").alias("e")),
        F.struct(F.lit("b").alias("side"), F.col("embedding_b").alias("e")))).alias("r")).select(
            key, "r.side", _vector("r.e").alias("e"))
    model = PCA(k=k, inputCol="e", outputCol="projected").fit(stacked)
    loadings = model.pc.toArray()
    mean = stacked.agg(Summarizer.mean(F.col("e")).alias("m")).first()["m"].toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(0), np.arange(k)])
    shift = mean @ loadings
    return model.transform(stacked).select(key, "side", vector_to_array("projected").alias("p")).select(
        key, "side", F.array(*[(F.element_at("p", i + 1) - float(shift[i])) * float(signs[i])
                               for i in range(k)]).alias("components"))


_MOMENTS = "low int, n bigint, mean array<double>, spread array<double>"


def _joined_moments(a, b):
    """Moments (n, mean, products of deviations of the dimensions from `low` on with all) of two sets of rows as one."""
    if a is None or b is None:
        return a if b is None else b
    low, n = a[0], a[1] + b[1]
    apart = b[2] - a[2]
    own = apart[low:low + len(a[3])]
    return low, n, a[2] + apart * (b[1] / n), a[3] + b[3] + np.outer(own, apart) * (a[1] * b[1] / n)


def _moment_rows(moments) -> pa.Table:
    rows = [m for m in moments if m is not None]
    return pa.table({"low": pa.array([m[0] for m in rows], pa.int32()), "n": pa.array([m[1] for m in rows], pa.int64()),
                     "mean": pa.array([m[2] for m in rows], pa.list_(pa.float64())),
                     "spread": pa.array([m[3].ravel() for m in rows], pa.list_(pa.float64()))})


def covariance_penalty(vectors: DataFrame, column: str = "embedding", width: int = 64) -> DataFrame:
    """One row `penalty`: the mean, over all pairs of dimensions, of their squared sample covariance; null for fewer than
    two vectors or dimensions. Null vectors take no part.

    Each task reduces its vectors to moments, cut into bands of `width` dimensions; moments of two sets merge exactly, so they
    are joined in two rounds and no task or driver sees more than a band of a few dozen sets.
    """
    def reduce(batches):
        found: dict[int, tuple] = {}
        for batch in batches:
            x = list_matrix(batch.column(column))
            mean = x.mean(axis=0)
            for low in range(0, x.shape[1], width):
                own = (low, len(x), mean, (x - mean)[:, low:low + width].T @ (x - mean))
                found[low] = _joined_moments(found.get(low), own)
        yield from _moment_rows(found.values()).to_batches()

    def join(group: pa.Table) -> pa.Table:
        whole = None
        for row in range(group.num_rows):
            mean, spread = (group[c][row].values.to_numpy(zero_copy_only=False) for c in ("mean", "spread"))
            whole = _joined_moments(whole, (group["low"][row].as_py(), group["n"][row].as_py(), mean,
                                            spread.reshape(-1, len(mean))))
        return _moment_rows([whole])

    moments = vectors.where(F.size(column) > 0).select(column).mapInArrow(reduce, _MOMENTS)
    moments = moments.withColumn("some", F.pmod(F.spark_partition_id(), F.lit(64)))
    moments = moments.groupBy("low", "some").applyInArrow(lambda g: join(g), _MOMENTS)
    moments = moments.groupBy("low").applyInArrow(lambda g: join(g), _MOMENTS)
    # entry e of a band is the pair (low + e div d, e mod d); each pair counts once
    size = F.size("mean")
    squares = F.transform("spread", lambda v, e: F.when(
        e % size > F.col("low") + F.floor(e / size), (v / (F.col("n") - 1)) * (v / (F.col("n") - 1))).otherwise(0.0))
    band = moments.where("n > 1").select(F.aggregate(squares, F.lit(0.0), lambda t, v: t + v).alias("total"), size.alias("d"))
    d = F.max("d")
    return band.agg(F.when(d > 1, F.sum("total") / (d * (d - 1) / 2)).alias("penalty"))


# ---------------------------------------------------------------- masked aggregates and distances

def masked_summary(df: DataFrame, keys: list[str], value: str, mask: str) -> DataFrame:
    """Sum, mean (0 over nothing), min and max of the values that are not masked out."""
    kept = F.when(~F.col(mask), F.col(value))
    return df.groupBy(*keys).agg(
        F.coalesce(F.sum(kept), F.lit(0.0)).alias("msum"), F.coalesce(F.avg(kept), F.lit(0.0)).alias("mmean"),
        F.min(kept).alias("mmin"), F.max(kept).alias("mmax"))


def pair_distances(pairs: DataFrame, a: str, b: str, modes=V.DISTANCE_MODES, p: float = 2.0) -> DataFrame:
    """One column a mode for given pairs of vectors."""
    return pairs.withColumns({m: V.distance(F.col(a), F.col(b), m, p) for m in modes})


# ---------------------------------------------------------------- in-batch reports

@dataclass
class _BatchPairs:
    """What travels of a batch: both vectors of each row, and the value of the row with itself."""

    columns = ["ea", "eb"]
    q_columns = ("own",)

    def weight(self, table: pa.Table) -> np.ndarray:
        return np.ones(table.num_rows, dtype=np.int64)


def _batch_rows(pairs: DataFrame, batch: str, key: Column, a: str, b: str, own) -> DataFrame:
    # a null batch is one of its own
    label = F.when(F.col(batch).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(batch).cast("string")))
    rows = pairs.select(F.col(batch).alias("batch"), label.alias("label"), key.alias("id"), F.col(a).alias("ea"), F.col(b).alias("eb"))
    return reliable_checkpoint(rows.withColumn("own", own))


def _batch_blocks(q: pa.Table, c: pa.Table):
    """(lo, hi, same batch) of blocks of query rows against all rows of a cell."""
    labels = pc.unique(pa.chunked_array([*q["label"].chunks, *c["label"].chunks]))
    left, right = (pc.index_in(t["label"], value_set=labels).to_numpy() for t in (q, c))
    height = max(1, tiles.LARGE_CELLS // max(1, c.num_rows))
    for lo in range(0, q.num_rows, height):
        hi = min(q.num_rows, lo + height)
        yield lo, hi, left[lo:hi, None] == right[None, :]


def retrieval_in_batch(pairs: DataFrame, batch: str = "batch_id", key: str = "id", a: str = "embedding_a",
                       b: str = "embedding_b", topk: tuple = (1, 5, 10), map_k: int = 10,
                       cell_rows: int = tiles.CELL_ROWS) -> DataFrame:
    """Per batch: HR@k of the own partner among the batch, MAP@k (1 / rank) and the mean matched product.

    Ties go to the smaller id; ids are unique in a batch. Batches share cells, and one above `cell_rows` gets a grid of its
    own: a cell gives the number of better partners of each row, never the matrix of products.
    """
    own = F.round(V.dot(F.col("ea"), F.col("eb")), tiles.SCORE_DIGITS)
    rows = _batch_rows(pairs, batch, F.col(key), a, b, own)

    def run(_, q: pa.Table, c: pa.Table) -> pa.Table:
        ahead = np.zeros(q.num_rows, np.int64)
        if q.num_rows and c.num_rows:
            ids = pc.unique(pa.chunked_array([*q["id"].chunks, *c["id"].chunks]))
            ids = ids.take(pc.array_sort_indices(ids))
            mine, others = (pc.index_in(t["id"], value_set=ids).to_numpy() for t in (q, c))
            left, right, bar = list_matrix(q["ea"]), list_matrix(c["eb"]), q["own"].to_numpy()
            for lo, hi, same in _batch_blocks(q, c):
                value = np.round(left[lo:hi] @ right.T, tiles.SCORE_DIGITS)
                tied = (value == bar[lo:hi, None]) & (others[None, :] < mine[lo:hi, None])
                better = ((value > bar[lo:hi, None]) | tied) & same & (others[None, :] != mine[lo:hi, None])
                ahead[lo:hi] = better.sum(axis=1)
        return pa.table({"label": q["label"], "id": q["id"], "ahead": pa.array(ahead)})

    kind = rows.schema["id"].dataType.simpleString()
    counted = tiles.label_cells(rows, rows, _BatchPairs(), run, f"label string, id {kind}, ahead bigint", cell_rows)
    ranks = rows.select("batch", "label", "id", "own").join(
        counted.groupBy("label", "id").agg((F.sum("ahead") + 1).alias("rank")), ["label", "id"])
    values = [F.avg((F.col("rank") <= k).cast("double")).alias(f"HR{k}") for k in topk]
    values += [F.avg(F.when(F.col("rank") <= map_k, 1.0 / F.col("rank")).otherwise(0.0)).alias(f"MAP{map_k}"),
               F.avg("own").alias("cosine_sim")]
    return ranks.groupBy("label").agg(F.first("batch").alias(batch), *values).drop("label")


def alignment_in_batch(pairs: DataFrame, batch: str = "batch_id", a: str = "embedding_a", b: str = "embedding_b",
                       alpha: float = 0.5, logit_scale: float = 1 / 0.07, cell_rows: int = tiles.CELL_ROWS) -> DataFrame:
    """Per batch: l_cos (1 - matched cosine), l_mse (difference of the two similarity matrices), their
    weighted total, and the contrastive cross-entropy of the matched partner among the batch.

    A cell gives, for each of its rows, the largest logit, the sum of exponentials relative to it, and the sum of squared
    differences; sums of cells are brought to a common largest logit, so a batch is never one matrix.
    """
    number = F.monotonically_increasing_id()
    rows = _batch_rows(pairs, batch, number, a, b, V.cosine(F.col("ea"), F.col("eb")))

    def run(_, q: pa.Table, c: pa.Table) -> pa.Table:
        top, total, apart = np.zeros(q.num_rows), np.zeros(q.num_rows), np.zeros(q.num_rows)
        if q.num_rows and c.num_rows:
            (qa, qb), (ca, cb) = ([list_matrix(t[n]) for n in ("ea", "eb")] for t in (q, c))
            for lo, hi, same in _batch_blocks(q, c):
                logits = np.where(same, score_block(qa[lo:hi], cb, "cosine") * logit_scale, -np.inf)
                # a batch has cells in a whole grid, so every row meets rows of its own batch
                top[lo:hi] = logits.max(axis=1)
                total[lo:hi] = np.exp(logits - top[lo:hi, None]).sum(axis=1)
                gap = (score_block(qa[lo:hi], ca, "cosine") - score_block(qb[lo:hi], cb, "cosine")) ** 2
                apart[lo:hi] = np.where(same, gap, 0.0).sum(axis=1)
        return pa.table({"label": q["label"], "id": q["id"], "top": pa.array(top), "total": pa.array(total),
                         "apart": pa.array(apart), "met": pa.array(np.full(q.num_rows, c.num_rows > 0))})

    parts = tiles.label_cells(rows, rows, _BatchPairs(), run,
                              "label string, id bigint, top double, total double, apart double, met boolean", cell_rows)
    merged = parts.where("met and total > 0").groupBy("label", "id").agg(
        F.collect_list(F.struct("top", "total")).alias("cells"), F.sum("apart").alias("apart"))
    merged = merged.withColumn("high", F.array_max(F.transform("cells", lambda x: x["top"])))
    # one entry a cell of the grid row
    scaled = F.aggregate("cells", F.lit(0.0), lambda t, x: t + x["total"] * F.exp(x["top"] - F.col("high")))
    rated = rows.select("batch", "label", "id", "own").join(
        merged.select("label", "id", "apart", (F.log(scaled) + F.col("high")).alias("spread")), ["label", "id"])
    n = F.count("*")
    out = rated.groupBy("label").agg(
        F.first("batch").alias(batch), (1.0 - F.avg("own")).alias("l_cos"), (F.sum("apart") / (n * n)).alias("l_mse"),
        F.avg(F.col("spread") - F.col("own") * logit_scale).alias("contrastive"))
    total = alpha * F.col("l_cos") + (1 - alpha) * F.col("l_mse")
    return out.select(batch, "l_cos", "l_mse", total.alias("total"), "contrastive")


# ---------------------------------------------------------------- frame alignment

def frame_shift(chunks: DataFrame, pairs: DataFrame, key: str = "perf", index: str = "idx",
                column: str = "embedding") -> DataFrame:
    """Shift between the two recordings of each given pair: perf_i, perf_j, shift_frame_i_to_j.

    Every chunk of i takes its nearest chunk of j (Euclid, only chunks at another index); the shift is the
    most frequent index difference, ties to the one seen at the smallest index. A recording against itself
    shifts by 0. The work is one row a chunk pair of the given pairs, never of a whole work.
    """
    left = chunks.select(F.col(key).alias("perf_i"), F.col(index).alias("idx_i"), F.col(column).alias("e_i"))
    right = chunks.select(F.col(key).alias("perf_j"), F.col(index).alias("idx_j"), F.col(column).alias("e_j"))
    pairs = pairs.select("perf_i", "perf_j").distinct()
    both = (pairs.where("perf_i <> perf_j").join(left, "perf_i").join(right, "perf_j")
            .where("idx_i <> idx_j")
            .withColumn("dist", F.round(V.distance(F.col("e_i"), F.col("e_j"), "euc"), 9)))
    nearest = both.groupBy("perf_i", "perf_j", "idx_i").agg(
        F.min(F.struct("dist", "idx_j")).alias("n")).withColumn("delta", F.col("idx_i") - F.col("n.idx_j"))
    votes = nearest.groupBy("perf_i", "perf_j", "delta").agg(
        F.count("*").alias("votes"), F.min("idx_i").alias("seen"))
    shifts = votes.groupBy("perf_i", "perf_j").agg(
        F.max_by("delta", F.struct("votes", (-F.col("seen")).alias("early"))).alias("shift_frame_i_to_j"))
    same = pairs.where("perf_i = perf_j").withColumn("shift_frame_i_to_j", F.lit(0))
    return shifts.unionByName(same)


def frame_shift_all(chunks: DataFrame, work: str = "work_id", key: str = "perf", index: str = "idx",
                    column: str = "embedding", cell_rows: int = tiles.CELL_ROWS) -> DataFrame:
    """`frame_shift` of all ordered pairs of recordings of a work, each with itself included.

    Chunks travel as one row a recording; many works share a cell, and a work with more chunks than `cell_rows` gets a grid of
    its own, so no task holds all of its pairs. One row a pair leaves a cell, the distances of chunks never do. A null
    work has no pairs; recordings without a chunk at another index have no shift.
    """
    rows = chunks.where(F.col(work).isNotNull()).groupBy(F.col(work).alias("label"), F.col(key).alias("id")).agg(
        F.sort_array(F.collect_list(F.struct(F.col(index).cast("bigint").alias("idx"), F.col(column).alias("e")))).alias("c"))
    items = rows.select("id", "label", F.col("c")["idx"].alias("idx"), F.col("c")["e"].alias("vectors"))
    found = tiles.positives(items, items, FrameShiftScorer("vectors"), cell_rows=cell_rows)
    kind = chunks.schema[index].dataType
    return (found.select(F.col("query_id").alias("perf_i"), F.col("corpus_id").alias("perf_j"),
                         F.col("score").cast(kind).alias("shift_frame_i_to_j"))
            .unionByName(items.select(F.col("id").alias("perf_i"), F.col("id").alias("perf_j"),
                                      F.lit(0).cast(kind).alias("shift_frame_i_to_j"))))
