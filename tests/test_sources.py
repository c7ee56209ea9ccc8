"""Data sources of our own, RDF feeds, blanks beyond ASCII."""

import pytest
from pyspark.sql import functions as F

from prismfeed.functions import clean, text
from prismfeed.operators import serving
from prismfeed.sources import feeds, landed
from prismfeed.streaming import queues


def drained(spark, path, mark):
    got = []
    s = spark.readStream.format("landed_feeds").option("path", path).load()
    s.writeStream.foreachBatch(lambda df, epoch: got.extend(df.collect())).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return {(r.source_id, r.seq): (r.status, r.not_modified, r.error, None if r.body is None else bytes(r.body)) for r in got}


def test_a_second_read_brings_only_what_is_new(spark, tmp_path):
    landed.register(spark)
    path, mark = str(tmp_path / "in"), str(tmp_path / "mark")
    schema = "source_id string, status int, error string, content_type string, etag string, last_modified string, body binary"
    put = lambda seq, *rows: landed.land(spark.createDataFrame([(s, st, e, "text/xml", tag, None, b) for s, st, e, tag, b in rows], schema), path, seq)
    put(1, ("a", 200, None, '"1"', b"one"), ("b", 0, "timed out", None, None), ("c", 200, None, None, b"plain"))
    assert drained(spark, path, mark) == {("a", 1): (200, False, None, b"one"), ("b", 1): (0, False, "timed out", None), ("c", 1): (200, False, None, b"plain")}
    assert drained(spark, path, mark) == {}
    put(2, ("a", 304, None, None, None), ("b", 200, None, '"b"', b"bee"), ("c", 503, None, None, None))
    put(3, ("a", 200, None, '"1"', b"one"), ("c", 200, None, None, b"plain"))
    assert drained(spark, path, mark) == {
        ("a", 2): (304, True, None, None), ("a", 3): (200, True, None, None), ("b", 2): (200, False, None, b"bee"), ("c", 2): (503, False, "Status code 503", None), ("c", 3): (200, False, None, b"plain"),
    }
    put(4, ("a", 200, None, '"2"', b"two"), ("d", 200, None, '"d"', b""))
    assert drained(spark, path, mark) == {("a", 4): (200, False, None, b"two"), ("d", 4): (200, False, None, b"")}
    assert landed.FeedStream(path).latestOffset()["a"][1] == '"2"' and landed.FeedStream(str(tmp_path / "none")).latestOffset() == {}


def test_many_sources_share_a_task(spark, tmp_path):
    landed.register(spark)
    path, mark, n = str(tmp_path / "in"), str(tmp_path / "mark"), 1100
    schema = "source_id string, status int, error string, content_type string, etag string, last_modified string, body binary"
    for seq in (1, 2):
        landed.land(spark.createDataFrame([(f"s{i}", 200, None, "text/xml", f"{i * (seq if i % 3 else 1)}", None, b"%d" % i) for i in range(n)], schema), path, seq)
        reader = landed.FeedStream(path)
        assert reader.latestOffset() == reader.latestOffset() and len(reader.partitions({}, reader.latestOffset())) == 3
        assert drained(spark, path, mark) == {(f"s{i}", seq): (200, (same := seq == 2 and i % 3 == 0), None, None if same else b"%d" % i) for i in range(n)}


def rows_of(spark, path):
    return sorted(r.id for r in spark.read.format("whole_archive").schema("id long, x string").option("path", path).load().collect())


def test_an_archive_appears_whole_or_not_at_all(spark, tmp_path):
    landed.register(spark)
    path = str(tmp_path / "archive")
    assert rows_of(spark, path) == []
    df = spark.range(0, 100, 1, 4).withColumn("x", F.lit("y"))
    df.write.format("whole_archive").option("path", path).mode("append").save()
    assert rows_of(spark, path) == [*range(100)]
    before = sorted(p.name for p in (tmp_path / "archive").rglob("*") if p.is_file())
    broken = spark.range(100, 200, 1, 4).withColumn("x", F.when(F.col("id") == 163, F.raise_error(F.lit("a task fails"))).otherwise(F.lit("y")))
    with pytest.raises(Exception, match="a task fails"):
        broken.write.format("whole_archive").option("path", path).mode("append").save()
    assert rows_of(spark, path) == [*range(100)] and sorted(p.name for p in (tmp_path / "archive").rglob("*") if p.is_file()) == before
    spark.range(100, 103).withColumn("x", F.lit(None).cast("string")).write.format("whole_archive").option("path", path).mode("append").save()
    assert rows_of(spark, path) == [*range(103)]
    with pytest.raises(Exception, match="only grows"):
        df.write.format("whole_archive").option("path", path).mode("overwrite").save()


def test_a_streamed_batch_is_archived_once(spark, tmp_path):
    landed.register(spark)
    path, folder = str(tmp_path / "archive"), str(tmp_path / "in")
    for k in range(3):
        spark.range(k * 10, k * 10 + 10).withColumn("x", F.lit("y")).coalesce(1).write.parquet(f"{folder}/part={k}")
    s = queues.arrivals_stream(spark, f"{folder}/part=*", spark.createDataFrame([], "id long, x string").schema, files=1)
    for mark in ("m1", "m1", "m2"):  # the last one has lost its checkpoint and delivers the same batches again
        s.writeStream.format("whole_archive").option("path", path).option("checkpointLocation", str(tmp_path / mark)).trigger(availableNow=True).start().awaitTermination()
        assert rows_of(spark, path) == [*range(30)]
    assert len([*(tmp_path / "archive/parts").glob("*/*.parquet")]) == len([*(tmp_path / "archive/manifests").iterdir()])


def test_rdf_after_rss_and_atom(spark):
    rdf = '<rdf:RDF xmlns:rdf="r" xmlns:dc="d"><channel><title>k</title></channel><item><title>bir</title><link>/1</link><dc:date>2024-04-18T09:00:00Z</dc:date></item><item><title>iki</title><link>/2</link><pubDate>Thu, 18 Apr 2024 10:00:00 GMT</pubDate></item></rdf:RDF>'
    docs = [("rdf", rdf), ("plain", "<RDF><item><title>x</title><link>/x</link></item></RDF>"), ("rss", "<rss><channel><item><title>r</title><link>/r</link></item></channel></rss>"), ("none", "<html/>"), ("null", None), ("empty", "<rdf:RDF/>")]
    got = feeds.parse_items(spark.createDataFrame(docs, "source_id string, xml string")).collect()
    assert sorted((r.source_id, r.title, r.link, r.date) for r in got) == sorted([("rdf", "bir", "/1", "2024-04-18T09:00:00Z"), ("rdf", "iki", "/2", "Thu, 18 Apr 2024 10:00:00 GMT"), ("plain", "x", "/x", None), ("rss", "r", "/r", None)], key=str)


def test_blanks_beyond_ascii_part_entities(spark):
    texts = ["akp chp", "yüzde 47 faiz", "central　bank", "% 20", "20 %", "akpchp"]
    got = [r.e for r in spark.createDataFrame([(t,) for t in texts], "t string").select(text.extract_entities(F.col("t")).alias("e")).collect()]
    assert {"akp", "chp"} <= {*got[0]} and "pct47" in got[1] and "tcmb" in got[2] and "pct20" in got[4] and not {"akp", "chp"} & {*got[5]}


def test_tags_go_at_once(spark):
    texts = ["<<a>b>", "a<b<c>d>e", "x < y", "<p>1</p>", "<a <b>>", None]
    plain = spark.createDataFrame([(t,) for t in texts], "t string").select(clean.strip_tags(F.col("t")).alias("s"), clean.strip_tags(clean.strip_tags(F.col("t"))).alias("twice")).collect()
    assert [r.s for r in plain] == ["b>", "ad>e", "x < y", "1", ">", None] and all(r.s == r.twice for r in plain)


def test_a_document_of_no_items(spark):
    empty = spark.createDataFrame([], "item string, n int")
    doc = serving.rss_document(empty, ["n"], "t", "d", "http://x", F.to_timestamp(F.lit("2024-01-31 00:00:00"))).first().document
    assert doc.endswith("<lastBuildDate>Wed, 31 Jan 2024 00:00:00 GMT</lastBuildDate></channel></rss>")
