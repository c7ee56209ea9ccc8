"""Tables between two steps of a plan, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in spark.checkpoint.dir or the context's checkpoint folder; where both are unset, in a temporary folder if the master is this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="prismfeed-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """df, written once and read again: what several steps use is computed once, and lineage ends there."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def freed(spark: SparkSession) -> None:
    """Let the driver collect its garbage now, not when its heap has grown: its cleaner then deletes the shuffle files of finished steps."""
    spark.sparkContext._jvm.System.gc()


def spread(df: DataFrame, key: str) -> DataFrame:
    """df, dealt out by a key if it comes in fewer partitions than there are cores (small tables of one file); large tables are left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
