"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from versionlake.operators.ids import fan_out_path, pending
from versionlake.operators.numbering import number_rows
from versionlake.session import reliable_checkpoint


def write_embeddings(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    if fmt not in ("parquet", "orc"):
        raise ValueError(f"unknown embedding format: {fmt}")
    df.write.mode(mode).format(fmt).save(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header that `read_metadata` reads back: quotes are doubled and blanks around a value stay."""
    (df.write.mode(mode).option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))


def write_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines; an empty table is refused."""
    if df.isEmpty():
        raise ValueError("nothing to write")
    df.write.mode(mode).json(path)


def write_ids(df: DataFrame, column: str, path: str, mode: str = "overwrite") -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode(mode).text(path)


def plan_shards(metadata: DataFrame, features: DataFrame, targets: DataFrame, key: str = "uid",
                shard_size: int = 1000) -> DataFrame:
    """Samples with both a feature and a target, numbered in key order into shards of at most `shard_size`."""
    kept = metadata.select(key).distinct().join(features, key).join(targets, key)
    return (number_rows(kept, [key], "_no").withColumn("shard_id", F.floor((F.col("_no") - 1) / shard_size))
            .drop("_no"))


def write_shards(metadata: DataFrame, features: DataFrame, targets: DataFrame, path: str, key: str = "uid",
                 shard_size: int = 1000, mode: str = "overwrite") -> dict[str, int]:
    """Write shards partitioned by shard_id; returns how many samples were kept and how many lacked data."""
    shards = plan_shards(metadata, features, targets, key, shard_size)
    (shards.withColumn("path", fan_out_path(F.col(key))).repartition("shard_id").sortWithinPartitions(key)
     .write.mode(mode).partitionBy("shard_id").parquet(path))
    kept = metadata.sparkSession.read.parquet(path).count()
    return {"kept": kept, "missing": metadata.select(key).distinct().count() - kept}


def append_pending(df: DataFrame, path: str, key: str = "md5_encoded", fmt: str = "parquet") -> DataFrame:
    """Append the rows whose key the output does not hold yet; returns the rows that were new.

    The new rows are checkpointed before the append, so that writing them does not change what they are.
    """
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
    fresh = pending(df, spark.read.format(fmt).load(path), key) if exists else df
    fresh = reliable_checkpoint(fresh)
    fresh.write.mode("append").format(fmt).save(path)
    return fresh
