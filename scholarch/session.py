"""Session defaults and job parameters.

Nothing here is read implicitly by operators: `now`, the run salt and the like are
arguments, so that a retried job gives the same rows.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# AQE sizes the shuffles, splits skewed join partitions and picks broadcast joins from
# measured sizes, so no operator hard-codes a broadcast of data that can grow.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(app: str = "scholarch", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: `spark.checkpoint.dir`.

    Only a local-mode session without that setting (tests, a laptop) falls back to a new
    scratch folder; on a cluster a missing setting is an error.
    """
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="spark-", dir="/tmp" if os.path.isdir("/tmp") else None)
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_location(spark: SparkSession, label: str) -> str:
    """A fresh, never reused path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage through a written Parquet table in the shared folder.

    The files outlive lost executors, and the reread table has exact size statistics, so
    later joins are planned from facts.
    """
    path = new_location(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def growing(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the data: merged, never broadcast.

    The planner goes by the size of the files, and a table of dictionary codes, or one whose rows are exploded
    after the reading, takes tens of times as much in the driver that would broadcast it.
    """
    return df.hint("merge")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash partition by the keys into a fixed number of tasks before work that multiplies rows.

    AQE sizes partitions by bytes and would run a small but explosive input in one task; a
    fixed number is left alone by it.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *keys)
