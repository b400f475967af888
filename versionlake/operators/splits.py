"""Data set splits, batch plans and shards. All choices are seeded hashes (`functions.seeded`)."""

from __future__ import annotations

import math
from bisect import bisect_left
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from versionlake.functions.seeded import seeded_hash, seeded_unit
from versionlake.operators.numbering import number_by_hash, number_within, quantiles
from versionlake.session import reliable_checkpoint

#: Works whose running ratio one task follows.
RANGE_WORKS = 100_000

# Strides for walking a ring of size below 2**31 without repeats (primes above 2**31).
STRIDES = [2147483659, 2147483693, 2147483713, 2147483743, 2147483777, 2147483783, 2147483813, 2147483857]


def _number(hash_col: Column, start: int) -> Column:
    """Eight hex digits of a hash as a number."""
    return F.conv(F.substring(hash_col, start, 8), 16, 10).cast("long")


def ring_walk(seed_hash: Column, step: Column, size: Column) -> Column:
    """Position of the step-th pick on a ring of `size` places: a seeded offset and a seeded stride that has
    no common factor with the size, so the first `size` picks are all different."""
    stride = F.element_at(F.array(*[F.lit(s) for s in STRIDES]), (_number(seed_hash, 1) % len(STRIDES) + 1).cast("int"))
    size = F.when(size < F.lit(2 ** 31), size).otherwise(F.raise_error(F.lit("a ring has at most 2**31 - 1 places")))
    return (_number(seed_hash, 9) + step * (stride % size)) % size


def train_val_test(df: DataFrame, key: str = "uid", train: float = 0.8, val: float = 0.5, seed: int = 42) -> DataFrame:
    """Add `split`: round(train * n) rows train, round(val * rest) val, others test."""
    n = df.count()
    n_train = round(train * n)
    n_val = round(val * (n - n_train))
    placed = number_by_hash(df.withColumn("_h", seeded_hash(seed, key)), "_h", "_no", (key,))
    split = (F.when(F.col("_no") <= n_train, "train").when(F.col("_no") <= n_train + n_val, "val")
             .otherwise("test"))
    return placed.withColumn("split", split).drop("_h", "_no")


def quartile_subsets(df: DataFrame, column: str) -> dict[str, DataFrame]:
    """Rows at or above the first quartile, the median and the third quartile (nested). The thresholds are one scalar
    subquery of the plan, which Spark evaluates once and hands to the filters. Without any number no row stays."""
    found = quantiles(df, column, [0.25, 0.5, 0.75])
    in_order = F.sort_array(F.collect_list(F.struct("probability", "value")))
    thresholds = found.agg(F.transform(in_order, lambda t: t["value"])).scalar()
    return {name: df.where(F.col(column) >= F.get(thresholds, i)) for i, name in enumerate(("q1", "median", "q3"))}


def split_by_work(df: DataFrame, key: str, work: str = "work_id", val_unseen: float = 0.0, test_unseen: float = 0.0,
                  val_ratio: float = 0.1, test_ratio: float = 0.1, seed: int = 42, keep_ratio: bool = False,
                  range_works: int = RANGE_WORKS) -> DataFrame:
    """Add `split`. Some works go to test or validation as a whole (at least one when asked for); in every
    other work a share of its rows, at least one, goes to each of validation and test.

    With `keep_ratio`, a work met when test holds more than `test_ratio` of what train holds so far, works held back for
    test included, gives test one row less, but one at least; see `_reduced_works`."""
    works = df.groupBy(work).agg(F.count("*").alias("_n")).withColumn("_wh", seeded_hash(seed, work))
    total = works.count()

    def held_back(part: float) -> int:
        """Works that leave as a whole: those whose place, counted from 1, is within the part; the first in any case."""
        return max(math.floor(total * part), 1) if part > 0 else 0

    n_test, n_val = held_back(test_unseen if test_ratio > 0 else 0.0), held_back(val_unseen)
    placed = number_by_hash(works, "_wh", "_w", (work,)).select(work, "_n", "_w")
    rows = number_within(df.withColumn("_h", seeded_hash(seed, work, key)), [work], "_h", "_r").join(placed, work)

    def share(ratio: float) -> Column:
        return F.greatest(F.lit(1), F.floor(F.col("_n") * ratio))

    v = share(val_ratio) if val_ratio > 0 or test_ratio > 0 else F.lit(0)
    t = share(test_ratio) if test_ratio > 0 else F.lit(0)
    if keep_ratio and test_ratio > 0:
        placed = reliable_checkpoint(placed.withColumn("_v", v).withColumn("_t", t))
        less = _reduced_works(placed, n_test, n_test + n_val, test_ratio, range_works)
        rows = rows.join(less.select("_w", F.lit(1).alias("_less")), "_w", "left")
        t = t - F.coalesce(F.col("_less"), F.lit(0))
        rows = rows.withColumn("_t", t).drop("_less")
        t = F.col("_t")
    split = (F.when(F.col("_w") <= n_test, "test").when(F.col("_w") <= n_test + n_val, "val")
             .when(F.col("_r") <= v, "val").when(F.col("_r") <= v + t, "test").otherwise("train"))
    return rows.withColumn("split", split).drop("_h", "_r", "_n", "_w", "_t")


def _thresholds(bounds: list[int]) -> list[int]:
    """Ascending thresholds t of a walk: from a count x it leads to x + number of t with t >= x.

    A work with bound c counts one more where the count before it is at most c. That holds up to a certain x, which becomes a
    threshold: the largest x that the works before lead to c or less, found by bisection as t - place rises.
    """
    found: list[int] = []
    for c in bounds:
        n = len(found)
        at = bisect_left(range(n), c - n + 1, key=lambda j: found[j] - j)
        found.insert(at, c - n + at)
    return found


def _reduced_works(works: DataFrame, n_test: int, n_held: int, ratio: float, range_works: int,
                   walk_works: int = RANGE_WORKS) -> DataFrame:
    """Places (`_w`) of the works that give test one row less because it is above `ratio` of train.

    `works` has _w (place from 1), _n rows, _v and _t. Whether a work is reduced depends on all works before it, but
    only through one number: with ratio = p / q, a reduction takes q + p off q * test - p * train, and everything else in that
    difference is a sum over the works before. So work i is reduced when at most c(i) works were reduced before it,
    c(i) coming from a prefix sum. The count after some works, as a function of the count x before them, is x plus the
    number of certain thresholds not below x, one threshold a work (`_thresholds`). Walks of about `walk_works` works, each a
    number of whole ranges, find theirs in parallel; one pass over the walks then gives the count each starts from, and the
    works are counted once, in parallel. The driver sees one number a walk.
    """
    part = Fraction(str(ratio))
    p, q = part.numerator, part.denominator
    left = F.greatest(F.col("_n") - F.col("_v"), F.lit(0))
    rest = works.where(F.col("_w") > n_held).select(
        "_w", "_t", left.alias("_left"), F.least("_t", left).alias("_test"),
        F.greatest(left - F.col("_t"), F.lit(0)).alias("_train"), F.floor(F.col("_w") / range_works).alias("_range"))
    held = works.where(F.col("_w") <= n_test).agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    # without train rows there is no ratio yet
    first = rest.where("_train > 0").agg(F.min("_w")).first()[0]
    if first is None:
        return rest.select("_w").limit(0)
    step = (F.lit(q) * F.col("_test") - F.lit(p) * F.col("_train")).alias("_step")
    steps = rest.select("*", step)
    sums = steps.groupBy("_range").agg(F.sum("_step").alias("_sum"))
    # one row a range
    before = F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.sum("_step").over(Window.partitionBy("_range").orderBy("_w").rowsBetween(Window.unboundedPreceding, -1))
    base = F.lit(q * held) + F.col("_before") + F.coalesce("_inside", F.lit(0))
    bounds = reliable_checkpoint(
        steps.withColumn("_inside", inside).join(offsets, "_range")
        .where((F.col("_w") > first) & (F.col("_t") >= 2) & (F.col("_left") >= F.col("_t")))
        .select("_range", "_w", F.floor((base - 1) / F.lit(q + p)).cast("bigint").alias("_bound")))

    walked = bounds.withColumn("_walk", F.floor(F.col("_range") / max(1, walk_works // range_works)))

    def summary(group: pa.Table) -> pa.Table:
        group = group.sort_by([("_w", "ascending")])
        return pa.table({"_walk": group["_walk"][:1], "_t": pa.array(
            [_thresholds(group["_bound"].to_pylist())], pa.list_(pa.int64()))})

    walks = reliable_checkpoint(walked.groupBy("_walk").applyInArrow(summary, "_walk bigint, _t array<bigint>"))
    starts, done = {}, 0
    for number in sorted(r["_walk"] for r in walks.select("_walk").collect()):
        starts[number] = done
        above = F.size(F.filter("_t", lambda t: t >= F.lit(done)))
        done += walks.where(F.col("_walk") == number).select(above).first()[0]

    def reduced(group: pa.Table) -> pa.Table:
        group = group.sort_by([("_w", "ascending")])
        done, places = starts[group["_walk"][0].as_py()], []
        for place, bound in zip(group["_w"].to_pylist(), group["_bound"].to_pylist()):
            if done <= bound:
                done += 1
                places.append(place)
        return pa.table({"_w": pa.array(places, pa.int64())})

    return walked.groupBy("_walk").applyInArrow(reduced, "_w bigint")


def stratified_folds(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Add `fold` 0..k-1: each label is dealt out evenly, starting at a seeded fold."""
    rows = number_within(df.withColumn("_h", seeded_hash(seed, key)), [label], "_h", "_r")
    offset = _number(seeded_hash(seed, label), 1) % k
    return rows.withColumn("fold", ((F.col("_r") - 1 + offset) % k).cast("int")).drop("_h", "_r")


def per_class_batches(df: DataFrame, key: str, label: str, m: int, batch_size: int, seed: int = 42) -> DataFrame:
    """Plan of batches with `m` rows of each of batch_size / m classes: batch_id, slot, label, key.

    Classes with fewer than m rows are repeated. The number of batches is the (repeated) row count over the
    batch size. Classes of a batch and rows of a class are picked by a seeded walk over their positions, so
    the plan costs one row a slot, not one a batch and class.
    """
    if batch_size % m:
        raise ValueError("m must divide the batch size")
    sizes = df.groupBy(label).agg(F.count("*").alias("_n"))
    sizes = number_by_hash(sizes.withColumn("_lh", seeded_hash(seed, label)), "_lh", "_no", (label,)).select(
        label, "_n", (F.col("_no") - 1).alias("_class"))
    repeated = F.col("_n") * F.when(F.col("_n") < m, F.ceil(F.lit(m) / F.col("_n"))).otherwise(F.lit(1))
    total, n_classes = sizes.agg(F.sum(repeated), F.count("*")).first()
    n_batches = int(total or 0) // batch_size
    per_batch = min(batch_size // m, int(n_classes))
    rows = number_within(df.select(key, label).withColumn("_h", seeded_hash(seed, key)), [label], "_h", "_r")
    slots = (df.sparkSession.range(n_batches).select(F.col("id").alias("batch_id"))
             .withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(per_batch - 1))))
             .withColumn("_class", ring_walk(seeded_hash(seed, F.lit("batch"), F.col("batch_id")), F.col("_c"),
                                             F.lit(n_classes)))
             .join(sizes, "_class")
             .withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(m - 1))))
             .withColumn("_pick", ring_walk(seeded_hash(seed, F.col("batch_id"), F.col(label)), F.col("_i"), repeated)
                         % F.col("_n") + 1)
             .withColumn("slot", F.col("_c") * m + F.col("_i")))
    return (slots.join(rows.select(label, key, F.col("_r").alias("_pick")), [label, "_pick"])
            .select("batch_id", "slot", label, key))


def anchor_groups(df: DataFrame, key: str, clique: str, n_per_class: int, length: str | None = None,
                  maxlen: float | None = None, audiolen: float = 0.0, p_samesong: float = 0.0,
                  seed: int = 42) -> DataFrame:
    """For every version the anchor itself (slot 0) and n_per_class - 1 other versions of its clique, cycled
    when there are too few; with probability `p_samesong` the anchor may be among them. `start_s` is a seeded
    offset that leaves `audiolen` seconds: anchor, slot, member, start_s.

    Members sit on a ring of hashed positions and are reached by position, so no clique is paired with itself.
    """
    placed = number_within(df.withColumn("_h", seeded_hash(seed, key)), [clique], "_h", "_p").withColumn(
        "_p", F.col("_p") - 1)
    sizes = df.groupBy(clique).agg(F.count("*").alias("_n")).where("_n >= 2")
    walk = seeded_hash(seed, F.lit("walk"), F.col(key))
    again = seeded_unit(seed, F.lit("same"), key) < p_samesong
    ring = F.col("_n") - F.when(again, 0).otherwise(1)
    step = ring_walk(walk, F.col("slot") - 1, ring) + F.when(again, 0).otherwise(1)
    slots = (placed.join(sizes, clique)
             .withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(n_per_class - 1))))
             .withColumn("_at", (F.col("_p") + F.when(F.col("slot") == 0, 0).otherwise(step)) % F.col("_n"))
             .select(clique, F.col(key).alias("anchor"), "slot", "_at"))
    members = placed.select(clique, F.col("_p").alias("_at"), F.col(key).alias("member"),
                            *([F.col(length).alias("_len")] if length else []))
    out = slots.join(members, [clique, "_at"])
    if length is None:
        return out.select("anchor", "slot", "member", F.lit(0.0).alias("start_s"))
    usable = F.least(F.lit(maxlen), F.col("_len")) if maxlen is not None else F.col("_len")
    start = F.greatest(F.lit(0.0), seeded_unit(seed, "anchor", "slot", "member") * (usable - audiolen))
    return out.select("anchor", "slot", "member", start.alias("start_s"))


def shuffle_batches(df: DataFrame, key: str, batch_size: int, seed: int = 42) -> DataFrame:
    """Seeded order and batches: row_no (1-based), batch_id."""
    placed = number_by_hash(df.withColumn("_h", seeded_hash(seed, key)), "_h", "row_no", (key,)).drop("_h")
    return placed.withColumn("batch_id", F.floor((F.col("row_no") - 1) / batch_size))
