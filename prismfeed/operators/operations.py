"""Queue metrics, health, rate limits and retry state."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Limits of queue depth, age in seconds, staleness of ingestion and clustering.
DEPTHS, OTHER_DEPTH, OLDEST, INGESTION, CLUSTERING = {"cluster_work": 500, "image_backfill": 100}, 100, 1800, 600, 900
POISON_READS, IMAGE_TRIES, PARK_DAYS, BUCKET_IDLE = 3, 5, 7, 600


def _age(now: Column, at: Column) -> Column:
    return F.floor((F.unix_micros(now) - F.unix_micros(at)) / 1e6)


def queue_metrics(queue: DataFrame, now: Column) -> DataFrame:
    """(queue_name, queue_length, newest_age, oldest_age in seconds) of messages published_at."""
    return queue.groupBy("queue_name").agg(F.count("*").alias("queue_length"), _age(now, F.max("published_at")).alias("newest_age"), _age(now, F.min("published_at")).alias("oldest_age"))


def queues_ok(metrics: DataFrame) -> DataFrame:
    """One row: whether no queue is too deep, too old or without a length; false without queues."""
    limit = F.coalesce(*[F.when(F.col("queue_name") == k, F.lit(v)) for k, v in DEPTHS.items()], F.lit(OTHER_DEPTH))
    length = F.expr("try_cast(queue_length as double)")
    ok = F.coalesce(length <= limit, F.lit(False)) & (F.coalesce(F.expr("try_cast(oldest_age as double)"), F.lit(0.0)) <= OLDEST)
    return metrics.agg(F.coalesce(F.bool_and(ok), F.lit(False)).alias("queues_ok"))


def health(articles: DataFrame, clusters: DataFrame, queue: DataFrame, now: Column) -> DataFrame:
    fresh = articles.agg((_age(now, F.max("published_at")) < INGESTION).alias("ingestion_ok"))
    moved = clusters.agg((_age(now, F.max("updated_at")) < CLUSTERING).alias("clustering_ok"))
    one = fresh.join(F.broadcast(moved)).join(F.broadcast(queues_ok(queue_metrics(queue, now))))  # single rows
    good = F.col("ingestion_ok") & F.col("clustering_ok") & F.col("queues_ok")
    return one.select("ingestion_ok", "clustering_ok", "queues_ok", F.when(good, "healthy").otherwise("degraded").alias("verdict"))


def drawn(tokens: float, last: float, at: float, capacity: float, refill: float, idle: float) -> tuple[bool, int, float]:
    """Whether a request at this time gets a token, else the wait in ms; and the tokens left. Times are in seconds; a bucket idle for too long is full."""
    tokens = capacity if at - last > idle else min(capacity, tokens + max(0.0, at - last) * refill)
    if tokens >= 1:
        return True, 0, tokens - 1
    return False, math.ceil((1 - tokens) / refill * 1000), tokens


def token_bucket(requests: DataFrame, capacity: float, refill: float, idle: float = BUCKET_IDLE) -> DataFrame:
    """(client, seq, allowed, retry_after_ms) of requests (client, seq, at: seconds): a bucket for each client, full at first.

    A bucket that was idle for longer than `idle` seconds is forgotten, so the
    next request finds a full one. The state runs along each client's requests in
    time; they are streamed in order through one task, with two numbers of state.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, tokens, last = object(), capacity, 0.0
        for b in batches:
            allowed, wait = [], []
            for c, at in zip(b["client"], b["at"], strict=True):
                if c != client:
                    client, tokens, last = c, capacity, at
                ok, ms, tokens = drawn(tokens, last, at, capacity, refill, idle)
                last = at
                allowed.append(ok)
                wait.append(ms)
            yield pd.DataFrame({"client": b["client"], "seq": b["seq"], "allowed": allowed, "retry_after_ms": wait})

    kind = requests.schema["client"].dataType.simpleString()
    ordered = requests.select("client", "seq", F.col("at").cast("double").alias("at")).repartition("client").sortWithinPartitions("client", "at", "seq")
    return ordered.mapInPandas(run, f"client {kind}, seq long, allowed boolean, retry_after_ms long")


def image_attempts(state: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """New image state after a try: a found image is set where none is and clears the count; five failures park the article for a week."""
    joined = state.join(results.select("article_id", "found"), "article_id", "left")
    lost = F.col("tried") & F.col("found").isNull()
    attempts = F.when(lost, F.col("attempts") + 1).when(F.col("found").isNotNull(), F.lit(0)).otherwise(F.col("attempts"))
    at = F.when(lost & (F.col("attempts") + 1 >= IMAGE_TRIES), now + F.expr(f"interval {PARK_DAYS} days")).when(F.col("tried"), now).otherwise(F.col("attempted_at"))
    return joined.select("article_id", F.coalesce("image_url", "found").alias("image_url"), attempts.alias("attempts"), at.alias("attempted_at"))


def lease(queue: DataFrame, now: Column, visibility: int, n: int) -> DataFrame:
    """queue (msg_id, read_ct, vt, message) after a read: `leased` marks the first n visible messages, which are read once more and hidden for so many seconds."""
    free = queue.filter(F.col("vt") <= now).orderBy("msg_id").limit(n).select("msg_id", F.lit(True).alias("leased"))
    marked = queue.join(F.broadcast(free), "msg_id", "left").withColumn("leased", F.coalesce("leased", F.lit(False)))  # n rows
    vt = F.when(F.col("leased"), F.timestamp_micros(F.unix_micros(now) + visibility * 1_000_000)).otherwise(F.col("vt"))
    return marked.withColumn("read_ct", F.col("read_ct") + F.col("leased").cast("int")).withColumn("vt", vt)


def settle(messages: DataFrame, failed: Column, article_id: Column, before_work: bool = False) -> DataFrame:
    """What becomes of each leased message: malformed and poisoned ones are archived, failed ones retried, the others done.

    A message is poisoned once it was read more often than allowed: if it fails
    again, or, with before_work, without another try.
    """
    worn = F.col("read_ct") > POISON_READS
    poisoned = worn if before_work else failed & worn
    return messages.withColumn("outcome", F.when(article_id.isNull(), "malformed").when(poisoned, "poison").when(failed, "retry").otherwise("done"))


def archive(settled: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """The archive's new rows (with archived_at), and the messages that stay in the queue."""
    return settled.filter("outcome <> 'retry'").withColumn("archived_at", now), settled.filter("outcome = 'retry'").drop("outcome")


def pool(jobs: DataFrame, workers: int, deadline: float) -> DataFrame:
    """(job, worker, start, ran) of jobs (job, seconds): each worker takes its jobs in turn and starts none after the deadline."""
    own = Window.partitionBy("worker").orderBy("job").rowsBetween(Window.unboundedPreceding, -1)
    dealt = jobs.withColumn("worker", F.pmod("job", F.lit(workers)))
    return dealt.withColumn("start", F.coalesce(F.sum("seconds").over(own), F.lit(0))).select("job", "worker", "start", (F.col("start") <= deadline).alias("ran"))


def cached_reads(reads: DataFrame, ttl: int) -> DataFrame:
    """reads (key, seq, at in seconds, invalidates) with `hit`: whether the view of the key was built before in this period of
    freshness and no invalidation of its tag came since; an invalidating row is itself a miss."""
    by = Window.partitionBy("key").orderBy("at", "seq")
    period = reads.withColumn("epoch", F.sum(F.col("invalidates").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("period", F.floor(F.col("at") / ttl))
    first = F.row_number().over(Window.partitionBy("key", "period", "epoch").orderBy("at", "seq"))
    return period.withColumn("hit", first > 1).select("key", "seq", "hit")
