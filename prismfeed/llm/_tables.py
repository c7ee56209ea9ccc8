"""Reading inputs and keeping intermediate tables for the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from prismfeed.staging import freed, scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df: DataFrame, label: str, free: bool = True) -> DataFrame:
    """Write a DataFrame to the shared folder and read it again: lineage ends there, and a lost executor loses nothing.

    free: let the driver's cleaner delete the shuffle files of finished steps now, not when its heap fills.
    """
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    if free:
        freed(df.sparkSession)
    return kept


def map_rows(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """mapInArrow for tables whose columns may have any names, dots and all: inside, they are c0, c1, ... in order, going in and coming out."""
    inner = StructType.fromJson(schema.jsonValue())
    for i, field in enumerate(inner.fields):
        field.name = f"c{i}"
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.mapInArrow(run, StructType(inner.fields)).toDF(*schema.names)
