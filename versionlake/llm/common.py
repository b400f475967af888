"""Small helpers of this subpackage: registry, written tables, task functions that travel by value."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

import versionlake

# Task functions travel with their code, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(versionlake)

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with the SQL for the same rows where SQL can express it."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that all executors share (`spark.checkpoint.dir`).

    Only a local session without that setting gets a temporary folder; elsewhere a missing setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="versionlake-llm-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/llm-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """`df`, written as Parquet in the shared folder and read again: cuts lineage, survives lost executors."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_order(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """`df`, written in the order of key and `order`, with the place `at` of every row in it.

    Rows are dealt by ranges, so a hot key lies in many tasks; a last random range column splits even rows that are
    wholly equal. Written, as sampled range bounds may differ between two evaluations.
    """
    whole = [key, *order, "__any"]
    dealt = df.withColumn("__any", F.rand(11)).repartitionByRange(*whole).sortWithinPartitions(*whole).drop("__any")
    return written(dealt.withColumn("at", F.monotonically_increasing_id()))


def ranked(ordered: DataFrame, key: str = "key") -> DataFrame:
    """Rows of `in_order` with rank (from 0) and n (rows) within the key, from the sizes of its parts in each range."""
    part = F.shiftright("at", 33)
    sizes = ordered.groupBy(key, part.alias("__part")).agg(F.count("*").alias("__n"), F.min("at").alias("__first"))
    parts = Window.partitionBy(key)
    before = F.sum("__n").over(parts.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(key, "__part", F.sum("__n").over(parts).alias("n"),
                         (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift"))
    return (ordered.withColumn("__part", part).join(sizes, [key, "__part"])
            .withColumn("rank", F.col("at") + F.col("__shift")).drop("__part", "__shift", "at"))


def text_of(docs: DataFrame, column: str = "text"):
    """The text column with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of an ASCII string."""
    step = "CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"
    bits = f"list_reduce([xor(c, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda a, x: {step})"
    codes = f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)"
    return f"xor(list_reduce([4294967295::BIGINT] || {codes}, lambda c, b: {bits}), 4294967295)"
