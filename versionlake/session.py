"""Session settings and the checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "versionlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; any key can be overridden through `conf`."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _checkpoint_root(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`. Only a local session without that setting gets a temporary one;
    on a cluster a machine-local folder would be lost with its executor, so a missing setting is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="versionlake-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the checkpoint folder that all executors share; `name` tells what it is for."""
    return f"{_checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df` with a reliable checkpoint in the shared folder of the cluster."""
    _checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def spread_small(df: DataFrame, key: str, bytes_per_core: int = 64 << 20) -> DataFrame:
    """Give every core a share of a small input before heavy per-row work.

    A file with one row group is read by one task however many cores there are. Inputs estimated above
    `bytes_per_core` a core already come in enough pieces and are left as they are, so the shuffle is bounded.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores, key) if size < cores * bytes_per_core else df
