"""Comparison reports, dataset summaries, timing tables and the best epoch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from versionlake.functions.seeded import seeded_hash
from versionlake.operators.ids import tag_union

# Compared metrics, suffixes of fused models with their block names, stand-alone models.
METRICS = ["MR1", "HR1", "HR10", "MAP10"]
FUSED_SUFFIXES = {
    "bge-m3+mean": "BGE Mean",
    "bge-m3+max": "BGE Max",
    "BM25+mean": "BM25 Mean",
    "BM25+max": "BM25 Max",
}
CORE_SUFFIXES = ["+BM25+mean", "+BM25+max", "+BAAI/bge-m3+mean", "+BAAI/bge-m3+max"]
SINGLE_MODELS = ["BAAI/bge-m3", "BM25", "BAAI/bge-m3-full"]
SINGLE_BLOCK = "Individual Models"


def _text(value):
    """Three decimals; a missing number prints as nan."""
    return F.when(value.isNotNull() & ~F.isnan(value), F.format_string("%.3f", value)).otherwise(F.lit("nan"))


def _against(df: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """Metric cells as `value (difference to the baseline)`; models without a baseline show nan."""
    base = baseline.select(F.col("model_name").alias(key), F.lit(True).alias("_known"),
                           *[F.col(m).alias(f"_{m}") for m in METRICS])
    joined = df.join(base, key, "left")
    cells = {m: F.concat(_text(F.col(m)), F.lit(" ("), _text(F.col(m) - F.col(f"_{m}")), F.lit(")"))
             for m in METRICS}
    return joined.withColumns(cells).drop(*[f"_{m}" for m in METRICS])


def report_fused(results: DataFrame, baseline: DataFrame) -> DataFrame:
    """Fused and lexical models against the dense baseline of the same core name, in blocks."""
    core = F.col("model_name")
    for suffix in CORE_SUFFIXES:
        core = F.replace(core, F.lit(suffix), F.lit(""))
    named = results.select("model_name", *METRICS).withColumn("core", core)
    cells = _against(named, baseline, "core")
    blocks = {}
    for suffix, block in FUSED_SUFFIXES.items():
        blocks[block] = (cells.where(F.col("model_name").endswith(suffix))
                         .select(F.when(F.col("_known"), F.col("core")).alias("model_name"), *METRICS))
    blocks[SINGLE_BLOCK] = cells.where(F.col("model_name").isin(SINGLE_MODELS)).select(
        "model_name", *[F.substring_index(m, " (", 1).alias(m) for m in METRICS])
    return tag_union(blocks, "type").orderBy(F.col("type").desc(), F.col("HR1").desc())


def report_reranked(results: DataFrame, baseline: DataFrame) -> DataFrame:
    """Re-ranked models against the baseline of the same name."""
    return _against(results.select("model_name", *METRICS), baseline, "model_name").select("model_name", *METRICS)


def report_against_one(results: DataFrame, baseline: DataFrame, baseline_model: str, target: str) -> DataFrame:
    """Models against one baseline row, which is matched to the model called `target`."""
    row = baseline.where(F.col("model_name") == baseline_model).withColumn("model_name", F.lit(target))
    return _against(results.select("model_name", *METRICS), row, "model_name").select("model_name", *METRICS)


def report_against_many(results: DataFrame, baseline: DataFrame, baseline_models: list[str],
                        target: str) -> DataFrame:
    """One block a baseline model, tagged with its name."""
    return tag_union({m: report_against_one(results, baseline, m, target) for m in baseline_models}, "baseline")


# ---------------------------------------------------------------- summaries

def status_counts(df: DataFrame, status: str = "status") -> DataFrame:
    return df.groupBy(status).agg(F.count("*").alias("n"))


def first_errors(df: DataFrame, key: str, status: str = "status", good: str = "ok", n: int = 10) -> DataFrame:
    return df.where(F.col(status) != good).orderBy(key).limit(n)


def timing_summary(timings: DataFrame, warm_up: int = 5, stage: str = "stage", index: str = "idx",
                   seconds: str = "seconds") -> DataFrame:
    """Mean and population deviation a stage without its first `warm_up` measurements (NaN when none is left)."""
    used = F.when(F.col(index) >= warm_up, F.col(seconds))
    nan = F.lit(float("nan"))
    return timings.groupBy(stage).agg(F.coalesce(F.avg(used), nan).alias("mean"),
                                      F.coalesce(F.stddev_pop(used), nan).alias("std"), F.count(used).alias("n"))


def seeded_sample(df: DataFrame, key: str, n: int = 200, seed: int = 42) -> DataFrame:
    """A sample of n rows, the first in seeded order."""
    return df.orderBy(seeded_hash(seed, key), key).limit(n)


def best_epoch(log: DataFrame, current: int, window: int, epoch: str = "epoch", test_set: str = "test_set",
               value: str = "map") -> DataFrame:
    """Epoch in [current - window, current] with the best mean over the test sets: epoch, mean.

    Each test set contributes its value at the nearest logged epoch, at most one away (the earlier on a
    tie); the first maximum wins. The log has one row an epoch and test set.
    """
    points = log.select(F.col(epoch).alias("e"), F.col(test_set).alias("s"), F.col(value).alias("v"))
    wanted = points.where(F.col("e").between(max(0, current - window), current)).select(
        F.col("e").alias("epoch")).distinct()
    near = wanted.withColumn("e", F.explode(F.array(F.col("epoch") - 1, F.col("epoch"), F.col("epoch") + 1)))
    nearest = near.join(points, "e").groupBy("epoch", "s").agg(
        F.min_by("v", F.struct(F.abs(F.col("e") - F.col("epoch")).alias("d"), "e")).alias("v"))
    means = nearest.groupBy("epoch").agg(F.avg("v").alias("mean"))
    return means.orderBy(F.col("mean").desc(), "epoch").limit(1)
