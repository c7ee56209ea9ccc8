"""Queues as file streams: fan-out on arrival, idempotent batches, watermarked aggregates."""

from __future__ import annotations

import time
from collections import Counter

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from prismfeed.schema import ZONES, in_politics, zone_of

#: Late articles are taken up for so long.
LATENESS = "48 hours"
# How often each worker starts.
SCHEDULE = {"ingest": "3 minutes", "cluster": "1 minute", "image": "5 minutes", "headline": "5 minutes"}


def fan_out(articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The messages that new articles cause: politics for clustering, articles without an image for the image search."""
    message = F.to_json(F.struct(F.col("id").cast("string").alias("article_id"))).alias("message")
    return articles.filter(in_politics(F.col("category"))).select(message), articles.filter("image_url is null").select(message)


def arrivals_stream(spark: SparkSession, path: str, schema, files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def redelivered(stream: DataFrame, write_batch, checkpoint: str) -> int:
    """Drains a stream whose first batch fails after it was written; how often that batch was delivered. write_batch must be idempotent by epoch."""
    seen: list[int] = []

    def once_broken(df: DataFrame, epoch: int) -> None:
        seen.append(epoch)
        write_batch(df, epoch)
        if len(seen) == 1:
            raise RuntimeError("the consumer was lost before its acknowledgement")

    try:
        drain(stream, once_broken, checkpoint).awaitTermination()
    except StreamingQueryException:
        drain(stream, once_broken, checkpoint).awaitTermination()
    return seen.count(seen[0]) if seen else 0


def drain(stream: DataFrame, write_batch, checkpoint: str) -> StreamingQuery:
    """Everything that is there now, in checkpointed batches. write_batch(df, epoch) must be idempotent by epoch."""
    return stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _Budget(StreamingQueryListener):
    """Tells which runs should end, as their time is nearly up or a batch brought less than a full one; and their batches."""

    def __init__(self, last: float, full: int):
        super().__init__()
        self.last, self.full, self.over, self.batches = last, full, set(), Counter()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        run, rows = str(event.progress.runId), event.progress.numInputRows
        self.batches[run] += rows > 0
        if rows < self.full or time.monotonic() > self.last:
            self.over.add(run)

    def onQueryIdle(self, event) -> None:
        self.over.add(str(event.runId))

    def onQueryTerminated(self, event) -> None:
        self.over.add(str(event.runId))


def drain_within(stream: DataFrame, write_batch, checkpoint: str, seconds: float, full: int, reserve: float = 5.0) -> int:
    """Batches until a budget is spent; how many there were. What is left stays for the next drain from the same checkpoint.

    Ends once fewer than `reserve` seconds are left, or after a batch of fewer than
    `full` rows, which tells that the queue is empty. A batch that is under way
    then is given up and comes again; write_batch(df, epoch) must be idempotent by
    epoch.
    """
    spark = stream.sparkSession
    deadline = time.monotonic() + seconds
    budget = _Budget(deadline - reserve, full)
    spark.streams.addListener(budget)
    try:
        q = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint).start()
        run = str(q.runId)
        while run not in budget.over and time.monotonic() < deadline and q.isActive:
            time.sleep(0.1)
        failed = q.exception()
        q.stop()
        if failed is not None:
            raise failed
    finally:
        spark.streams.removeListener(budget)
    return budget.batches[run]


def closed_days(stream: DataFrame, key: str, lateness: str = "24 hours", time: str = "published_at") -> DataFrame:
    """(start, key, count, zones, is_blindspot) of each day, once, when the lateness has passed after its end.

    In append mode a row never changes after it was written. A story of a day is
    a blindspot if one zone alone wrote of it.
    """
    zoned = stream.withWatermark(time, lateness).withColumn("zone", zone_of(F.col("bias")))
    present = [F.max((F.col("zone") == z).cast("int")) for z in ZONES]
    zones = sum((F.coalesce(p, F.lit(0)) for p in present), F.lit(0))
    counted = zoned.groupBy(F.window(time, "1 day"), key).agg(F.count("*").alias("count"), zones.cast("int").alias("zones"))
    return counted.select(F.col("window.start").alias("start"), key, "count", "zones", (F.col("zones") == 1).alias("is_blindspot"))


def fresh_articles(stream: DataFrame, table: DataFrame, time: str = "published_at") -> DataFrame:
    """The articles (url, source_id, content_hash, ...) of a stream that neither it nor the table has had.

    First by url, then by source and hash (a missing hash is like no other), each
    within the lateness; then by both against the table. A repeat of an url is gone
    before its hash counts.
    """
    own = F.coalesce(F.col("content_hash"), F.concat(F.lit("url:"), F.col("url")))
    once = stream.withWatermark(time, LATENESS).dropDuplicatesWithinWatermark(["url"]).withColumn("_hash", own).dropDuplicatesWithinWatermark(["source_id", "_hash"]).drop("_hash")
    left = once.join(table.select("url").distinct(), "url", "left_anti")
    return left.join(table.filter("content_hash is not null").select("source_id", "content_hash").distinct(), ["source_id", "content_hash"], "left_anti")


def fan_out_batch(out: str):
    """A batch writer to two queues; a batch that is written again replaces itself."""

    def write(df: DataFrame, epoch: int) -> None:
        df = df.persist()
        for name, messages in zip(("cluster_work", "image_backfill"), fan_out(df), strict=True):
            messages.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/{name}/epoch={epoch}")
        df.unpersist()

    return write


def deduplicated(stream: DataFrame, time: str = "published_at", keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """Each key once, as long as repeats come within the lateness."""
    return stream.withWatermark(time, LATENESS).dropDuplicatesWithinWatermark(list(keys))


def zone_windows(stream: DataFrame, width: str = "1 day", time: str = "published_at") -> DataFrame:
    """Counts by window and zone of an event-time stream."""
    zoned = stream.withWatermark(time, LATENESS).withColumn("zone", zone_of(F.col("bias")))
    return zoned.groupBy(F.window(time, width), "zone").agg(F.count("*").alias("count")).select(F.col("window.start").alias("start"), "zone", "count")
