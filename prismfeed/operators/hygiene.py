"""Deduplication, upserts, repairs and other table maintenance as whole-table plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Parts that what is read of one split of a file is grouped in.
PARTS_A_SPLIT = 16


def keep_first(df: DataFrame, keys: list[str], order: list, unless: Column | None = None) -> DataFrame:
    """The first row of each key by the order; rows where `unless` holds are all kept and not sorted."""
    w = Window.partitionBy(*keys).orderBy(*order)
    if unless is None:
        return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    rest = df.filter(~F.coalesce(unless, F.lit(False)))
    return rest.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn").unionByName(df.filter(unless))


def upsert_ignore(table: DataFrame, batch: DataFrame) -> DataFrame:
    """The rows of a batch to append: unknown by url and by (source_id, content_hash), the first of each within the batch."""
    fresh = keep_first(batch, ["url"], ["seq"])
    fresh = keep_first(fresh, ["source_id", "content_hash"], ["seq"], unless=F.col("content_hash").isNull())
    fresh = fresh.join(table.select("url"), "url", "left_anti")
    return fresh.join(table.filter("content_hash is not null").select("source_id", "content_hash"), ["source_id", "content_hash"], "left_anti")


def upsert_update(table: DataFrame, batch: DataFrame, key: str, version: str) -> DataFrame:
    """Both tables with the latest version of each key."""
    return table.unionByName(batch).groupBy(key).agg(*[F.max_by(c, version).alias(c) for c in table.columns if c != key]).select(*table.columns)


def link(bridge: DataFrame, new: DataFrame) -> DataFrame:
    """(cluster_id, article_id) with new links added once, each marked whether it was inserted."""
    old, fresh = (x.select("cluster_id", "article_id", F.lit(k).alias("known")) for x, k in ((bridge, True), (new, False)))
    both = old.union(fresh)
    # rows go to parts in proportion to the splits that are read, so what a task groups does not grow with the tables
    parts = max(int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")), PARTS_A_SPLIT * both.rdd.getNumPartitions())
    marked = both.repartition(parts, "cluster_id", "article_id").groupBy("cluster_id", "article_id").agg(F.bool_or("known").alias("known"))
    return marked.select("cluster_id", "article_id", (~F.col("known")).alias("inserted"))


def patch(table: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """The table with the patches' values where they are given."""
    named = patches.select(key, *[F.col(c).alias(f"_new_{c}") for c in patches.columns if c != key])
    joined = table.join(named, key, "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if f"_new_{c}" in joined.columns else F.col(c) for c in table.columns])


def delete_cascade(table: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return table.join(gone.select(key).distinct(), key, "left_anti")


def crud(table: DataFrame, creates: DataFrame, patches: DataFrame, deletes: DataFrame, key: str, unique: str) -> DataFrame:
    """table after deletes, patches and creates, in this order; a row to create goes if its `unique` value is taken."""
    left = patch(table.join(deletes.select(key), key, "left_anti"), patches, key)
    return left.unionByName(creates.join(left.select(unique), unique, "left_anti").select(*left.columns))


def cascade_delete(gone: DataFrame, children: dict[str, DataFrame], key: str) -> dict[str, DataFrame]:
    """What stays of each child table (with `key`) when the rows `gone` are deleted."""
    return {name: delete_cascade(child, gone, key) for name, child in children.items()}
