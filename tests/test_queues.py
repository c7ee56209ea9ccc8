"""Drains within a budget, keyed deduplication, days that are closed once."""

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from prismfeed.plans.stream_queries import replayed
from prismfeed.streaming import queues

T0 = datetime(2024, 1, 1)


def queue_of(spark, folder, files):
    for k in range(files):
        spark.range(k * 10, k * 10 + 10).coalesce(1).write.parquet(f"{folder}/part={k:02d}")
    return queues.arrivals_stream(spark, f"{folder}/part=*", spark.range(1).schema, files=1)


def test_a_slow_sink_ends_with_its_budget_and_goes_on(spark, tmp_path):
    stream, out, mark = queue_of(spark, tmp_path / "q", 9), str(tmp_path / "out"), str(tmp_path / "mark")

    def slow(df, epoch):
        df.write.mode("overwrite").parquet(f"{out}/batch={epoch}")
        time.sleep(1.5)

    began = time.monotonic()
    first = queues.drain_within(stream, slow, mark, seconds=12, full=10, reserve=5)
    assert 1 <= first < 9 and time.monotonic() - began < 25
    rest = queues.drain_within(stream, lambda df, epoch: df.write.mode("overwrite").parquet(f"{out}/batch={epoch}"), mark, seconds=90, full=10)
    assert rest >= 1
    while queues.drain_within(stream, lambda df, epoch: df.write.mode("overwrite").parquet(f"{out}/batch={epoch}"), mark, seconds=30, full=10):
        pass
    assert sorted(r.id for r in spark.read.schema("id long").option("recursiveFileLookup", True).parquet(out).collect()) == [*range(90)]


def test_a_failing_sink_is_told(spark, tmp_path):
    def broken(df, epoch):
        raise RuntimeError("no disk")

    with pytest.raises(Exception, match="no disk"):
        queues.drain_within(queue_of(spark, tmp_path / "q", 1), broken, str(tmp_path / "mark"), seconds=30, full=1)


def test_fresh_articles_by_both_keys(spark):
    rows = [
        (0, 1, "a", 1, "h1", 0), (0, 2, "b", 1, "h2", 1), (0, 3, "c", 1, None, 2), (0, 4, "d", 1, None, 2), (0, 5, "known", 9, "x", 2), (0, 6, "e", 2, "h1", 3), (0, 7, "f", 8, "held", 3),
        (1, 11, "a", 5, "new", 4), (1, 12, "z", 1, "h2", 5), (1, 13, "c", 1, None, 6), (1, 14, "y", 1, None, 6), (1, 15, "b", 7, "h7", 6), (1, 16, "v", 7, "h7", 7), (1, 17, "u", 9, "held", 7),
    ]
    df = spark.createDataFrame([(T0 + timedelta(days=9 + k), i, u, s, h, T0 + timedelta(hours=t)) for k, i, u, s, h, t in rows], "landed timestamp, id long, url string, source_id long, content_hash string, published_at timestamp")
    table = spark.createDataFrame([("known", 1, None), ("other", 8, "held")], "url string, source_id long, content_hash string")
    got = replayed(spark, df, "landed", lambda s: queues.fresh_articles(s, table).select("id"), "id long", slices=2)
    assert sorted(r.id for r in got.collect()) == [1, 2, 3, 4, 6, 14, 16, 17]


def test_a_closed_day_comes_once_with_its_laggards(spark):
    rows = [(k, T0 + timedelta(hours=h), b, "s") for k, h, b in [(0, 1, "opposition"), (0, 2, "opposition"), (1, 26, "center"), (1, 20, "center"), (2, 50, "state_media"), (2, 27, "state_media"), (3, 120, "center"), (3, 1, "nationalist")]]
    df = spark.createDataFrame([(T0 + timedelta(days=20 + k), *r) for k, *r in rows], "landed timestamp, published_at timestamp, bias string, story string")
    got = replayed(spark, df, "landed", lambda s: queues.closed_days(s, "story"), "start timestamp, story string, count long, zones int, is_blindspot boolean", slices=4).orderBy("start").collect()
    # the last row lands when its day was closed long ago
    assert [(r.start, r["count"], r.zones, r.is_blindspot) for r in got] == [(T0, 3, 2, False), (T0 + timedelta(days=1), 2, 2, False), (T0 + timedelta(days=2), 1, 1, True)]
