"""Row numbers without sending a whole table, or a whole hot key, through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from versionlake.session import reliable_checkpoint

HEX_DIGITS = 3
HOT_ROWS = 1_000_000
LARGEST = 2 ** 63 - 1


def number_by_hash(df: DataFrame, hash_col: str, out: str = "row_no", ties: tuple = ()) -> DataFrame:
    """1-based position in the order of a hex hash column.

    Rows are bucketed by the first hex digits; each bucket is numbered by itself and shifted by the sizes
    of the buckets before it. The table of sizes has at most 16**3 rows, so its window and broadcast are bounded.
    """
    bucketed = df.withColumn("_bucket", F.substring(hash_col, 1, HEX_DIGITS))
    sizes = bucketed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_bucket").orderBy(hash_col, *ties))
    return (bucketed.join(F.broadcast(offsets), "_bucket")
            .withColumn(out, F.col("_before") + local).drop("_bucket", "_before"))


def number_rows(df: DataFrame, order: list, out: str = "row_no") -> DataFrame:
    """1-based position in a total order over any columns.

    Range partitioning, then partition sizes, then local numbers plus an offset. The range-partitioned rows
    are checkpointed first: sampled range bounds may differ between two evaluations.
    """
    ordered = (df.repartitionByRange(*order).sortWithinPartitions(*order)
               .withColumn("_part", F.spark_partition_id()))
    ordered = reliable_checkpoint(ordered)
    sizes = ordered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return (ordered.join(F.broadcast(offsets), "_part")
            .withColumn(out, F.col("_before") + local).drop("_part", "_before"))


def number_within(df: DataFrame, keys: list[str], hash_col: str, out: str = "row_no",
                  hot_rows: int = HOT_ROWS) -> DataFrame:
    """1-based position inside each key in the order of a hex hash column.

    A key with more than `hot_rows` rows is cut by hash prefix into buckets that are numbered separately.
    There are at most rows / hot_rows such keys; Spark picks the join by the measured size of their list.
    """
    hot = (df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows)
           .select(*keys, F.lit(True).alias("_hot")))
    marked = (df.join(hot, keys, "left")
              .withColumn("_bucket", F.when(F.col("_hot"), F.substring(hash_col, 1, HEX_DIGITS))
                          .otherwise(F.lit(""))))
    sizes = marked.where("_hot").groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(
        Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select(*keys, "_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    local = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(hash_col))
    return (marked.join(offsets, [*keys, "_bucket"], "left")
            .withColumn(out, F.coalesce(F.col("_before"), F.lit(0)) + local)
            .drop("_hot", "_bucket", "_before"))


def first_per_key(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """First row of each key in an explicit order, as a partial aggregate (no window over a hot key)."""
    rest = [c for c in df.columns if c not in keys]
    picked = F.min_by(F.struct(*rest), F.struct(*[
        (F.col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)]))
    return df.groupBy(*keys).agg(picked.alias("_row")).select(*keys, "_row.*").select(*df.columns)


def _sortable(value: Column) -> Column:
    """A double as a long in the same order: its bits, with all but the sign turned round for negative numbers."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), value).cast("long")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit(LARGEST))).otherwise(bits)


def _from_sortable(key: Column) -> Column:
    bits = F.when(key < 0, key.bitwiseXOR(F.lit(LARGEST))).otherwise(key)
    return F.java_method(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double")


def quantiles(df: DataFrame, column: str, probabilities: list[float], interpolation: str = "linear",
              buckets: int = 1 << 16) -> DataFrame:
    """Exact quantiles as a plan: one row (probability, value) for each probability, in no order.

    `linear` interpolates between neighbours, `nearest` takes the value at round(q * (n - 1)), half to even. Nulls take
    no part, NaN is the largest number, and without any number every value is null.

    Selection by rounds. A double is taken as a whole number of the same order; a round counts the numbers by their next
    leading bits, inside the ranges only that hold a wanted rank, and keeps the ranges in which the ranks fall. After the last bits a
    range is one number. So nothing is sorted and no row is shuffled: a task hands on at most `buckets` counts (from
    2**8 to 2**16, raised to a power of two) for each of two ranges a probability, however hot a number is, and the
    ranges that the next round joins are as few. The column must give the same numbers whenever it is evaluated.
    """
    width = min(16, max(8, (buckets - 1).bit_length()))
    number = F.col(column).cast("double")
    # adding zero makes one zero of both
    keys = df.where(F.col(column).isNotNull()).select(_sortable(number + F.lit(0.0)).alias("key"))
    left = 64 - width
    counts = keys.groupBy(F.shiftright("key", left).alias("range")).agg(F.count("*").alias("n"))
    wanted_shares = F.array(*[F.lit(float(q)) for q in probabilities])

    def spot(q: Column) -> Column:
        place = q * (F.col("total") - 1)
        return F.bround(place, 0) if interpolation == "nearest" else place

    def above(place: Column) -> Column:
        return F.least(F.floor(place) + 1, F.col("total") - 1)

    ranks = F.flatten(F.transform(wanted_shares, lambda q: F.array(F.floor(spot(q)), above(spot(q)))))
    counts = (counts.withColumn("total", F.sum("n").over(Window.partitionBy()))
              .withColumn("ranks", F.array_distinct(ranks))
              .withColumn("upto", F.sum("n").over(Window.orderBy("range"))))

    def holding(counted: DataFrame) -> DataFrame:
        """The ranges that hold wanted ranks, with these and the number of values before."""
        before = F.col("upto") - F.col("n")
        inside = F.filter("ranks", lambda r: (r >= before) & (r < F.col("upto")))
        return (counted.withColumn("ranks", inside).where(F.size("ranks") > 0)
                .select("range", "ranks", before.alias("before"), "total"))

    wanted = holding(counts)
    while left > 0:
        step = min(width, left)
        joined = keys.withColumn("range", F.shiftright("key", left)).join(F.broadcast(wanted), "range")
        left -= step
        counts = (joined.groupBy("range", "ranks", "before", "total", F.shiftright("key", left).alias("next"))
                  .agg(F.count("*").alias("n")))
        running = F.sum("n").over(Window.partitionBy("range").orderBy("next"))
        wanted = holding(counts.withColumn("upto", running + F.col("before")).withColumn("range", F.col("next")))
    at = wanted.select(F.explode("ranks").alias("rank"), _from_sortable(F.col("range")).alias("v"), "total")
    whole = at.agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"), F.first("total").alias("total"))
    place = spot(F.col("probability"))
    share = place - F.floor(place)
    low, high = F.try_element_at("at", F.floor(place)), F.try_element_at("at", above(place))
    value = F.when(share > 0, low + (high - low) * share).otherwise(low)
    return whole.select(F.explode(wanted_shares).alias("probability"), "at", "total").select(
        "probability", value.alias("value"))


def quantile_values(df: DataFrame, column: str, probabilities: list[float],
                    interpolation: str = "linear", buckets: int = 1 << 16) -> list[float]:
    """`quantiles` as numbers in the order of `probabilities`; NaN for each if there is no number."""
    found = {r["probability"]: r["value"] for r in quantiles(df, column, probabilities, interpolation, buckets).collect()}
    return [float("nan") if found[float(q)] is None else found[float(q)] for q in probabilities]
