"""Cluster aggregates that are maintained batch by batch, not recomputed.

A view is a folder: `links` and `clusters`, each with a part for every epoch, and
`commits`, which names the epochs that are complete. An epoch's part of
`clusters` holds the rows of the clusters that its batch touched, and no others;
the newest row of a cluster is the one that counts. Every few epochs the parts
are folded into one, so that readers see few of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismfeed.schema import BIAS_KEYS

#: Epochs between two foldings.
FOLD_EVERY = 16
_LINK, _CLUSTER = "cluster_id {kind}, article_id {kind}", "cluster_id {kind}, article_count long, counts array<long>, first_published timestamp, updated_at timestamp"


class LinkedClusters:
    """Links of articles to clusters, and what follows from them for each cluster.

    Links are rows (cluster_id, article_id, bias, published_at); an unknown or
    missing bias counts as center. Links of a null id are left out, repeated ones
    count once, whether within a batch or over batches. Batches come in order of
    their epochs. One that comes again replaces what it wrote; one older than the
    newest complete epoch changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, kind: str = "long", fold_every: int = FOLD_EVERY):
        self.spark, self.path, self.fold_every = spark, path, fold_every
        self._link, self._cluster = _LINK.format(kind=kind), _CLUSTER.format(kind=kind)

    def create(self) -> LinkedClusters:
        """An empty view, complete as of epoch -1."""
        for name, schema in (("links", self._link), ("clusters", self._cluster)):
            self.spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{self.path}/{name}/epoch=-1")
        self._commit(-1, True)
        return self

    def _commit(self, epoch: int, folded: bool) -> None:
        self.spark.range(1).select(F.lit(epoch).cast("long").alias("epoch"), F.lit(folded).alias("folded")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/of={epoch}")

    def epochs(self, before: int | None = None) -> list[int]:
        """The complete epochs that make up the view, or made it up before an epoch, oldest first: a folded one and those after it."""
        rows = self.spark.read.schema("epoch long, folded boolean").option("recursiveFileLookup", True).parquet(f"{self.path}/commits").collect()  # a row an epoch
        rows = [r for r in rows if before is None or r.epoch < before]
        start = max(r.epoch for r in rows if r.folded)
        return sorted(r.epoch for r in rows if r.epoch >= start)

    def _read(self, name: str, schema: str, epochs: list[int]) -> DataFrame:
        parts = [f"{self.path}/{name}/epoch={e}" for e in epochs]
        return self.spark.read.schema(f"{schema}, epoch long").option("basePath", f"{self.path}/{name}").parquet(*parts)

    def _newest(self, epochs: list[int]) -> DataFrame:
        rows = self._read("clusters", self._cluster, epochs)
        held = [c for c in rows.columns if c not in ("cluster_id", "epoch")]
        return rows.groupBy("cluster_id").agg(F.max_by(F.struct(*held), "epoch").alias("r")).select("cluster_id", "r.*")

    def apply(self, batch: DataFrame, epoch: int, now: Column) -> None:
        """Take up a batch of links as this epoch (fit for foreachBatch); every cluster it names is stamped with `now`."""
        if self.epochs()[-1] > epoch:
            return
        before = self.epochs(epoch)
        links = batch.filter("cluster_id is not null and article_id is not null").dropDuplicates(["cluster_id", "article_id"]).persist()
        try:
            touched = links.select("cluster_id").distinct()
            known = self._read("links", self._link, before).drop("epoch").join(touched, "cluster_id", "left_semi")
            fresh = links.join(known, ["cluster_id", "article_id"], "left_anti")
            fold = len(before) >= self.fold_every
            kept = self._read("links", self._link, before).drop("epoch") if fold else None
            rows = fresh.select("cluster_id", "article_id")
            (rows.unionByName(kept) if fold else rows).write.mode("overwrite").parquet(f"{self.path}/links/epoch={epoch}")
            bias = F.when(F.col("bias").isin(*BIAS_KEYS), F.col("bias")).otherwise("center")
            delta = fresh.groupBy("cluster_id").agg(F.count("*").alias("n"), F.array(*[F.count_if(bias == k) for k in BIAS_KEYS]).alias("c"), F.min("published_at").alias("p"))
            old = self._newest(before)
            mine = touched.join(delta, "cluster_id", "left").join(old, "cluster_id", "left")
            zero = F.array_repeat(F.lit(0).cast("long"), len(BIAS_KEYS))
            new = mine.select(
                "cluster_id", (F.coalesce("article_count", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("long").alias("article_count"),
                F.zip_with(F.coalesce("counts", zero), F.coalesce("c", zero), lambda a, b: a + b).alias("counts"),
                F.least("first_published", "p").alias("first_published"), now.alias("updated_at"),
            )
            if fold:
                new = new.unionByName(old.join(touched, "cluster_id", "left_anti"))
            new.write.mode("overwrite").parquet(f"{self.path}/clusters/epoch={epoch}")
            self._commit(epoch, fold)  # the last write: without it the epoch's parts are not read
        finally:
            links.unpersist()

    def links(self) -> DataFrame:
        """(cluster_id, article_id)"""
        return self._read("links", self._link, self.epochs()).drop("epoch")

    def clusters(self) -> DataFrame:
        """(cluster_id, article_count, bias_distribution, is_blindspot, blindspot_side, first_published, updated_at)"""
        keys = F.array(*map(F.lit, BIAS_KEYS))
        present = F.map_filter(F.map_from_arrays(keys, "counts"), lambda _, n: n > 0)
        single = F.size(present) == 1
        return self._newest(self.epochs()).select(
            "cluster_id", "article_count", present.alias("bias_distribution"), single.alias("is_blindspot"), F.when(single, F.map_keys(present)[0]).alias("blindspot_side"), "first_published", "updated_at"
        )


def recomputed(links: DataFrame) -> DataFrame:
    """The same aggregates, but for updated_at, from all links at once."""
    bias = F.when(F.col("bias").isin(*BIAS_KEYS), F.col("bias")).otherwise("center")
    once = links.filter("cluster_id is not null and article_id is not null").dropDuplicates(["cluster_id", "article_id"])
    counts = once.groupBy("cluster_id", bias.alias("bias")).agg(F.count("*").alias("n"), F.min("published_at").alias("p"))
    single = F.count("*") == 1
    return counts.groupBy("cluster_id").agg(
        F.sum("n").alias("article_count"), F.map_from_entries(F.collect_list(F.struct("bias", "n"))).alias("bias_distribution"), single.alias("is_blindspot"), F.when(single, F.max("bias")).alias("blindspot_side"), F.min("p").alias("first_published")
    )  # ten biases at most


def repair(members: DataFrame, order: list, now: Column) -> tuple[DataFrame, DataFrame]:
    """(links, clusters) after one repair: of the members of a source in a cluster the first by `order` stays, and all aggregates follow from what stays."""
    from prismfeed.operators.hygiene import keep_first

    kept = keep_first(members, ["cluster_id", "source_id"], order)
    return kept, recomputed(kept).withColumn("updated_at", now)
