"""SparkSession factory with the settings every plan of this package relies on."""

from __future__ import annotations

import os

from pyspark import SparkConf, SparkContext
from pyspark.sql import SparkSession


def get_session(app: str = "prismfeed", cores: str | None = None) -> SparkSession:
    """A session in UTC with AQE and Arrow on.

    On a cluster the master, shuffle partitions, memory and checkpoint folder come
    from spark-submit or the environment; the values here only fill what is unset.
    """
    cores = cores or os.environ.get("BENCH_CPUS", "8")
    fill = {
        "spark.master": os.environ.get("SPARK_MASTER", f"local[{cores}]"), "spark.sql.shuffle.partitions": os.environ.get("SPARK_SHUFFLE_PARTITIONS", cores), "spark.driver.memory": os.environ.get("SPARK_DRIVER_MEMORY", "8g"),
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
    }
    if "PYSPARK_GATEWAY_PORT" in os.environ:  # under spark-submit the JVM runs already and knows what was set
        SparkContext._ensure_initialized()
    submitted = SparkConf()
    return SparkSession.builder.appName(app).config(map={k: v for k, v in fill.items() if k == "spark.sql.session.timeZone" or not submitted.contains(k)}).getOrCreate()
