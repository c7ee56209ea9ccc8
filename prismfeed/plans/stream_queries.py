"""Feed ingestion and streaming queries; the streams replay driver tables as files until all is drained."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from prismfeed.functions import clean
from prismfeed.operators.hygiene import delete_cascade
from prismfeed.operators.operations import cached_reads, lease, pool, token_bucket
from prismfeed.plans import proxy as P
from prismfeed.plans.registry import query
from prismfeed.sources import feeds, landed
from prismfeed.staging import scratch, staged
from prismfeed.streaming import queues, stateful

SQL_FEEDS = """feeds AS (SELECT page_id AS source_id, page_id % 3 AS kind, url, CASE WHEN page_id % 3 = 1 THEN 'Karışık İğne ' ELSE 'Café ' END || page_id AS title FROM pages)"""


def _feeds(spark, sf):
    """A feed of each page: RSS in ISO-8859-1 by its prolog (0), Atom in UTF-8 by its header (1), and documents that are none (2)."""
    page, url = F.col("page_id"), clean.escape_xml(F.col("url"))
    name = page.cast("string")
    rss = F.concat(
        F.lit('<?xml version="1.0" encoding="ISO-8859-1"?><rss><channel><item><title>Café '), name, F.lit("</title><link>"), url, F.lit("</link><description>Körper &amp;lt;b&amp;gt;gol&amp;lt;/b&amp;gt;</description><pubDate>Thu, 18 Apr 2024 10:00:00 GMT</pubDate>"),
        F.lit('<enclosure url="https://e.example/photo.jpg" type="image/jpeg"/></item><item><title> </title><link>/empty</link></item></channel></rss>'),
    )
    atom = F.concat(F.lit("<feed><entry><title>Karışık İğne "), name, F.lit('</title><link rel="self" href="https://x.example/self"/><link rel="alternate" href="'), url, F.lit('"/><summary>TCMB dolar</summary><published>2024-04-18T09:00:00Z</published></entry></feed>'))
    kind = page % 3
    body = F.when(kind == 0, F.encode(rss, "ISO-8859-1")).when(kind == 1, F.encode(atom, "UTF-8")).otherwise(F.encode(F.lit("<html>not a feed</html>"), "UTF-8"))
    return P.table(spark, sf, "pages").select(page.alias("source_id"), F.when(kind == 1, "application/xml; charset=utf-8").when(kind == 0, "text/xml").alias("content_type"), body.alias("body"))


@query("SELECT page_id AS source_id, CASE WHEN page_id % 3 = 0 THEN 'windows-1252' ELSE 'utf-8' END AS charset FROM pages")
def src_charset_decode(spark, sf):
    return feeds.decode_bodies(_feeds(spark, sf)).select("source_id", "charset")


@query(f"WITH {SQL_FEEDS} SELECT source_id, title, url AS link FROM feeds WHERE kind = 0 UNION ALL SELECT source_id, '', '/empty' FROM feeds WHERE kind = 0 UNION ALL SELECT source_id, title, url FROM feeds WHERE kind = 1")
def src_xml_parse(spark, sf):
    return feeds.parse_items(feeds.decode_bodies(_feeds(spark, sf))).select("source_id", "title", "link")


@query("SELECT page_id AS source_id, 'Haber ' || page_id || ' & ' || n AS title, url || '#' || n AS link, '2024-04-18T09:00:00Z' AS date FROM pages, (VALUES (1), (2)) t(n)")
def src_rdf_items(spark, sf):
    """RSS 1.0: items beside the channel, each page a document of two."""
    page, url = F.col("page_id").cast("string"), clean.escape_xml(F.col("url"))
    item = lambda n: F.concat(F.lit("<item><title>Haber "), page, F.lit(f" &amp; {n}</title><link>"), url, F.lit(f"#{n}</link><dc:date>2024-04-18T09:00:00Z</dc:date></item>"))
    head = '<?xml version="1.0"?><rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns="http://purl.org/rss/1.0/"><channel><title>Kanal</title></channel>'
    body = F.encode(F.concat(F.lit(head), item(1), item(2), F.lit("</rdf:RDF>")), "UTF-8")
    docs = P.table(spark, sf, "pages").select(F.col("page_id").alias("source_id"), F.lit("application/rdf+xml").alias("content_type"), body.alias("body"))
    return feeds.parse_items(feeds.decode_bodies(docs)).select("source_id", "title", "link", "date")


@query(f"WITH {SQL_FEEDS} SELECT source_id, title, url AS link, 'TCMB dolar' AS summary, '2024-04-18T09:00:00Z' AS date FROM feeds WHERE kind = 1")
def src_atom_entry_map(spark, sf):
    atom = _feeds(spark, sf).filter("source_id % 3 = 1")
    return feeds.parse_items(feeds.decode_bodies(atom)).select("source_id", "title", "link", "summary", "date")


@query(f"""WITH {SQL_FEEDS} SELECT source_id, title, CASE WHEN kind = 0 THEN 'https://e.example/photo.jpg' END AS image_url, CASE WHEN kind = 0 THEN 'Körper gol' ELSE 'TCMB dolar' END AS description, CASE WHEN kind = 0 THEN '2024-04-18 10:00:00' ELSE '2024-04-18 09:00:00' END AS published_at FROM feeds WHERE kind < 2""")
def src_rss_item_map(spark, sf):
    f = _feeds(spark, sf)
    sources = f.select(F.col("source_id").alias("id"), F.lit("s").alias("slug"), F.lit("https://b.example/").alias("url"))
    rows = feeds.normalise(feeds.parse_items(feeds.decode_bodies(f)), sources, P.as_of())
    return rows.select("source_id", "title", "image_url", "description", P.stamp("published_at").alias("published_at"))


_SQL_STATUS = "CASE WHEN page_id % 7 = 0 THEN 304 WHEN page_id % 11 = 0 THEN 503 WHEN page_id % 13 = 0 THEN 0 ELSE 200 END"


def _responses(spark, sf):
    """Logged responses: the feeds' bodies, some unchanged, some failed, some with an etag or a date."""
    page = F.col("source_id")
    tag = F.when(page % 2 == 0, F.concat(F.lit('"e'), page.cast("string"), F.lit('"')))
    when = F.when(page % 5 == 0, F.lit("Thu, 18 Apr 2024 10:00:00 GMT"))
    status = F.expr(_SQL_STATUS.replace("page_id", "source_id"))
    return _feeds(spark, sf).select("source_id", status.cast("int").alias("status"), F.when(status == 0, F.lit("Request timed out after 10000ms")).alias("error"), "content_type", tag.alias("etag"), when.alias("last_modified"), "body")


def _cache(spark, sf):
    page = F.col("page_id")
    return P.table(spark, sf, "pages").filter("page_id % 3 < 2").select(page.alias("source_id"), F.lit('"old"').alias("etag"), F.lit(None).cast("string").alias("last_modified"))


@query(f"""WITH r AS (SELECT page_id AS source_id, page_id % 3 AS kind, {_SQL_STATUS} AS status FROM pages) SELECT source_id, status, status = 304 AS not_modified, CASE status WHEN 0 THEN 'Request timed out after 10000ms' WHEN 503 THEN 'Status code 503' END AS error, CASE WHEN status <> 200 THEN 0 ELSE [2, 1, 0][kind + 1] END AS items FROM r""")
def src_rss_fetch(spark, sf):
    """Responses with the number of items that were read of each."""
    got = feeds.fetch_results(_responses(spark, sf))
    items = feeds.parse_items(feeds.decode_bodies(got.filter("body is not null"))).groupBy("source_id").agg(F.count("*").cast("int").alias("items"))
    return got.join(items, "source_id", "left").select("source_id", "status", "not_modified", "error", F.coalesce("items", F.lit(0)).alias("items"))


@query(f"""WITH r AS (SELECT page_id AS id, {_SQL_STATUS} = 200 AND (page_id % 2 = 0 OR page_id % 5 = 0) AS fresh FROM pages) SELECT id AS source_id, CASE WHEN NOT fresh THEN CASE WHEN id % 3 < 2 THEN '"old"' END WHEN id % 2 = 0 THEN '"e' || id || '"' END AS if_none_match, CASE WHEN fresh AND id % 5 = 0 THEN 'Thu, 18 Apr 2024 10:00:00 GMT' END AS if_modified_since FROM r""")
def src_conditional_cache(spark, sf):
    """The headers of the next requests, after the cache took up these responses."""
    r = _responses(spark, sf)
    return feeds.conditional_headers(r.select("source_id"), feeds.refreshed_cache(_cache(spark, sf), r))


_SQL_SECOND = "CASE WHEN page_id % 4 = 0 THEN 304 WHEN page_id % 6 = 1 THEN 503 ELSE 200 END"


@query(f"""WITH r AS (SELECT page_id AS id, {_SQL_STATUS} AS s1, {_SQL_SECOND} AS s2 FROM pages), n AS (SELECT id, 1 AS seq, s1 AS status, s1 = 304 AS same FROM r UNION ALL SELECT id, 2, s2, s2 = 304 OR (s2 = 200 AND s1 = 200 AND id % 2 = 0 AND id % 3 <> 0) FROM r)
SELECT CAST(id AS VARCHAR) AS source_id, seq, seq - 1 AS run, status, same AS not_modified, CASE status WHEN 0 THEN 'Request timed out after 10000ms' WHEN 503 THEN 'Status code 503' END AS error, status = 200 AND NOT same AS has_body FROM n""")
def src_feed_stream(spark, sf):
    """Two rounds of responses as they land; the stream ends after the first and starts again: then only the second round's rows come, and bodies of those that changed."""
    landed.register(spark)
    first, path, out, mark = _responses(spark, sf), scratch(spark, "landed"), scratch(spark, "stream"), scratch(spark, "mark")
    page = F.col("source_id")
    tag = F.when(page % 2 == 0, F.concat(F.when(page % 3 == 0, '"n').otherwise('"e'), page.cast("string"), F.lit('"')))
    second = first.withColumn("status", F.expr(_SQL_SECOND.replace("page_id", "source_id")).cast("int")).withColumn("etag", tag)
    for run, rows in enumerate((first, second)):
        landed.land(rows, path, run + 1)
        s = spark.readStream.format("landed_feeds").option("path", path).load()
        write = lambda df, epoch, run=run: df.withColumn("run", F.lit(run)).write.mode("overwrite").parquet(f"{out}/run={run}/batch={epoch}")
        s.writeStream.foreachBatch(write).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(f"{landed.RESPONSE}, run int").option("recursiveFileLookup", True).parquet(out)
    return rows.select("source_id", "seq", "run", "status", "not_modified", "error", F.col("body").isNotNull().alias("has_body"))


@query("SELECT n_nationkey AS id, n_name AS name FROM nation")
def src_seed_csv(spark, sf):
    """A seed table written as CSV with a header and read with its declared schema."""
    path = scratch(spark, "seed")
    P.table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")).write.option("header", True).csv(path)
    return spark.read.option("header", True).schema("id int, name string").csv(path)


# ---- streams --------------------------------------------------------------------------------------------------------------


def _stream(spark, sf):
    """Events as a file stream; event times are cast as in the batch view."""
    e = P.table(spark, sf, "events")
    raw = spark.readStream.schema(e.schema).option("pathGlobFilter", "events*").parquet(sf)
    return raw.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("published_at"), (F.col("user_id") % P.N_SOURCES).alias("source_id"), P.bias_of(F.col("user_id")).alias("bias"), "event_type", "user_id")


def _written(spark, stream, mode: str, schema: str):
    """What a stream wrote when all was drained, with the batch of each row."""
    out = scratch(spark, "stream")

    def write(df, epoch):
        df.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", scratch(spark, "mark")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(out)


def _drained(spark, sf, plan, mode: str, schema: str):
    return _written(spark, plan(_stream(spark, sf)), mode, schema)


def replayed(spark, rows, time: str, plan, schema: str, slices: int = 3):
    """What a stateful stream makes of rows that land in slices of time; after each, the query ends and starts again from its checkpoint."""
    rows = staged(rows.filter(F.col(time).isNotNull()), "log")
    first, last = rows.agg(F.min(F.unix_micros(time)), F.max(F.unix_micros(time))).first()
    folder, out, mark = scratch(spark, "landed"), scratch(spark, "stream"), scratch(spark, "mark")
    place = F.least(F.lit(slices - 1), F.floor((F.unix_micros(time) - (first or 0)) * slices / max(1, (last or 0) - (first or 0))))

    def write(df, epoch):
        df.write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    for k in range(slices):
        rows.filter(place == k).write.parquet(f"{folder}/slice={k}")
        with stateful.rocksdb(spark):
            s = plan(spark.readStream.schema(rows.schema).option("recursiveFileLookup", True).parquet(folder))
            s.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(out)


_SQL_DAY = f"WITH {P.SQL_ARRIVALS} SELECT strftime(date_trunc('{{unit}}', published_at), '%Y-%m-%d %H:%M:%S') AS start, {P.sql_zone('bias')} AS zone, count(*) AS count FROM arrivals GROUP BY 1, 2"


@query(_SQL_DAY.format(unit="day"))
def st_tumbling_day(spark, sf):
    out = _drained(spark, sf, lambda s: queues.zone_windows(s, "1 day"), "complete", "start timestamp, zone string, count long")
    return out.select(P.stamp("start").alias("start"), "zone", "count")


@query(_SQL_DAY.format(unit="hour"))
def st_tumbling_hour(spark, sf):
    out = _drained(spark, sf, lambda s: queues.zone_windows(s, "1 hour"), "complete", "start timestamp, zone string, count long")
    return out.select(P.stamp("start").alias("start"), "zone", "count")


def _in_files(spark, parts, name: str) -> str:
    """A folder that holds each part as one file of its own, in order of arrival."""
    folder = scratch(spark, name)
    for k, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{folder}/part={k}")
        time.sleep(0.05)  # files are taken up in order of their times
    return folder


def _arrivals_by_file(spark, folder: str, schema, files: int | None = None):
    return queues.arrivals_stream(spark, f"{folder}/part=*", schema, files)


@query(f"""WITH {P.SQL_ARRIVALS}, x AS (SELECT max(published_at) AS newest FROM arrivals) SELECT strftime(date_trunc('day', published_at), '%Y-%m-%d %H:%M:%S') AS start, {P.sql_zone('bias')} AS zone, count(*) AS count FROM arrivals, x
WHERE published_at >= newest - INTERVAL 24 HOUR OR date_trunc('day', published_at) + INTERVAL 24 HOUR > newest - INTERVAL 48 HOUR GROUP BY 1, 2""")
def st_late_data(spark, sf):
    """The last day arrives first, all before it late: windows that ended over 48 hours before the newest article take no more rows."""
    e = P.arrivals(spark, sf).select("id", "published_at", "bias")
    newest = e.agg(F.max("published_at")).first()[0]
    fresh = e.filter(F.col("published_at") >= F.lit(newest) - F.expr("interval 24 hours"))
    tip = F.col("published_at") == F.lit(newest)
    # two batches of fresh rows: late rows are held against the watermark of the batch before theirs
    folder = _in_files(spark, [fresh.filter((F.col("id") % 2 == 0) | tip), fresh.filter((F.col("id") % 2 != 0) & ~tip), e.filter(F.col("published_at") < F.lit(newest) - F.expr("interval 24 hours"))], "late")
    out = scratch(spark, "windows")

    def write(df, epoch):
        df.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    counted = queues.zone_windows(_arrivals_by_file(spark, folder, e.schema, files=1), "1 day")
    counted.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", scratch(spark, "mark")).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema("start timestamp, zone string, count long, epoch long").option("recursiveFileLookup", True).parquet(out)
    return rows.groupBy("start", "zone").agg(F.max_by("count", "epoch").alias("count")).select(P.stamp("start").alias("start"), "zone", "count")


@query("SELECT event_id AS id, 1 AS times FROM events")
def st_dedupe(spark, sf):
    """All events, and in a later file those of the last 40 hours once more."""
    e = P.arrivals(spark, sf).select("id", "published_at")
    newest = e.agg(F.max("published_at")).first()[0]
    folder = _in_files(spark, [e, e.filter(F.col("published_at") > F.lit(newest) - F.expr("interval 40 hours"))], "repeats")
    out = _written(spark, queues.deduplicated(_arrivals_by_file(spark, folder, e.schema, files=1)).select("id"), "append", "id long")
    return out.groupBy("id").agg(F.count("*").cast("int").alias("times"))


@query("SELECT event_id AS msg_id, event_id % 4 + CASE WHEN rn <= 50 THEN 1 ELSE 0 END AS read_ct, rn <= 50 AS leased, CASE WHEN rn <= 50 THEN '2024-01-31 00:01:00' WHEN event_id % 3 = 0 THEN '2024-01-31 00:00:30' ELSE '2024-01-30 23:59:00' END AS vt FROM (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN row_number() OVER (PARTITION BY event_id % 3 = 0 ORDER BY event_id) END AS rn FROM events) e".replace("rn <= 50 AS leased", "coalesce(rn <= 50, FALSE) AS leased"))
def src_queue_read(spark, sf):
    """A lease of 50 messages for a minute; a third of the queue is hidden by other readers."""
    vt = F.when(F.col("event_id") % 3 == 0, F.lit(30)).otherwise(-60)
    q = P.table(spark, sf, "events").select(F.col("event_id").alias("msg_id"), (F.col("event_id") % 4).cast("int").alias("read_ct"), F.timestamp_micros(F.unix_micros(P.as_of()) + vt * 1_000_000).alias("vt"), F.lit("{}").alias("message"))
    return lease(q, P.as_of(), 60, 50).select("msg_id", "read_ct", "leased", P.stamp("vt").alias("vt"))


@query(f"WITH {P.SQL_ARRIVALS} SELECT count(*) AS n, count(DISTINCT id) AS ids, 2 AS deliveries FROM arrivals")
def st_at_least_once(spark, sf):
    """The first batch is delivered twice, as its consumer is lost after writing it; its rows are there once."""
    out, mark = scratch(spark, "stream"), scratch(spark, "mark")
    times = queues.redelivered(_stream(spark, sf).select("id"), lambda df, epoch: df.write.mode("overwrite").parquet(f"{out}/epoch={epoch}"), mark)
    rows = spark.read.schema("id long").option("recursiveFileLookup", True).parquet(out)
    return rows.agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.lit(times).alias("deliveries"))


@query(f"""WITH {P.SQL_ARRIVALS}, z AS (SELECT date_trunc('day', published_at) AS start, event_type, {P.sql_zone('bias')} AS zone FROM arrivals), x AS (SELECT max(published_at) AS newest FROM arrivals)
SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS count, CAST(count(DISTINCT zone) AS INTEGER) AS zones, count(DISTINCT zone) = 1 AS is_blindspot FROM z, x WHERE start + INTERVAL 48 HOUR <= newest GROUP BY start, event_type""")
def st_closed_days(spark, sf):
    """Days of each story, once they are over for 24 hours; a seventh of the articles lands up to twenty hours late."""
    late = F.when(F.col("id") % 7 == 0, F.expr("make_interval(0, 0, 0, 0, 1 + pmod(id, 20))")).otherwise(F.expr("make_interval(0)"))
    log = P.arrivals(spark, sf).select("id", "published_at", "bias", "event_type").withColumn("landed_at", F.col("published_at") + late)
    out = replayed(spark, log, "landed_at", lambda s: queues.closed_days(s, "event_type"), "start timestamp, event_type string, count long, zones int, is_blindspot boolean")
    return out.withColumn("start", P.stamp("start"))


_SQL_FRESH = """WITH b AS (SELECT event_id AS id, 'u' || event_id AS url, user_id % 30 AS source_id, CASE WHEN event_id % 9 <> 0 THEN CAST(event_id * 3 AS VARCHAR) END AS content_hash FROM events),
t AS (SELECT 'u' || (o_orderkey * 5) AS url, o_orderkey % 30 AS source_id, CAST(o_orderkey AS VARCHAR) AS content_hash FROM orders)
SELECT id FROM b WHERE url NOT IN (SELECT url FROM t) AND NOT EXISTS (SELECT 1 FROM t WHERE t.source_id = b.source_id AND t.content_hash = b.content_hash)"""


@query(_SQL_FRESH)
def st_dedupe_keys(spark, sf):
    """Arrivals, and in a second file each once more with its url, and with its source and hash, of hours later; against the known articles in orders."""
    e = P.table(spark, sf, "events")
    hash_ = F.when(F.col("event_id") % 9 != 0, (F.col("event_id") * 3).cast("string"))
    one = e.select(F.col("event_id").alias("id"), F.concat(F.lit("u"), F.col("event_id").cast("string")).alias("url"), (F.col("user_id") % 30).alias("source_id"), hash_.alias("content_hash"), F.col("ts").cast("timestamp").alias("published_at"))
    same_url = one.withColumn("content_hash", F.lit("other")).withColumn("published_at", F.expr("published_at + interval 3 hours")).withColumn("id", -F.col("id") - 1)
    same_hash = one.filter("content_hash is not null").withColumn("url", F.concat("url", F.lit("/again"))).withColumn("published_at", F.expr("published_at + interval 5 hours")).withColumn("id", -F.col("id") - 1)
    k = F.col("o_orderkey")
    table = P.table(spark, sf, "orders").select(F.concat(F.lit("u"), (k * 5).cast("string")).alias("url"), (k % 30).alias("source_id"), k.cast("string").alias("content_hash"))
    log = one.withColumn("landed_at", P.as_of()).unionByName(same_url.unionByName(same_hash).withColumn("landed_at", F.timestamp_micros(F.unix_micros(P.as_of()) + 60_000_000)))
    return replayed(spark, log, "landed_at", lambda s: queues.fresh_articles(s, table).select("id"), "id long", slices=2)


@query(f"WITH {P.SQL_ARRIVALS} SELECT count(*) AS n, count(DISTINCT id) AS ids FROM arrivals")
def st_budget_drain(spark, sf):
    """Drains of a minute each until one finds the queue empty; a batch that was given up at the end of a drain comes again and is there once."""
    e = P.arrivals(spark, sf).select("id", "published_at")
    folder, out, mark = scratch(spark, "queue"), scratch(spark, "stream"), scratch(spark, "mark")
    e.repartition(8).write.parquet(folder)
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(folder)
    while queues.drain_within(stream, lambda df, epoch: df.write.mode("overwrite").parquet(f"{out}/batch={epoch}"), mark, seconds=60, full=1):
        pass
    return spark.read.schema("id long").option("recursiveFileLookup", True).parquet(out).agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


@query(f"WITH {P.SQL_ARRIVALS} SELECT id % 4 AS epoch, count(*) AS n FROM arrivals GROUP BY 1")
def st_budget(spark, sf):
    """Four files with a budget of one file a batch: each batch takes its share until all is drained."""
    e = P.arrivals(spark, sf).select("id", "published_at")
    folder = _in_files(spark, [e.filter(F.col("id") % 4 == k) for k in range(4)], "budget")
    out = _written(spark, _arrivals_by_file(spark, folder, e.schema, files=1).select("id"), "append", "id long, epoch long")
    return out.groupBy("epoch").agg(F.count("*").alias("n"))


@query(f"WITH {P.SQL_ARRIVALS} SELECT worker, every, count(*) AS n FROM arrivals, (VALUES ('ingest', '3 minutes'), ('cluster', '1 minute'), ('image', '5 minutes'), ('headline', '5 minutes')) s(worker, every) GROUP BY 1, 2")
def st_schedule(spark, sf):
    """Each worker's stream starts by its period; its first batch is awaited."""
    counts = []
    for worker, every in queues.SCHEDULE.items():
        out = scratch(spark, "stream")
        q = _stream(spark, sf).select("id").writeStream.foreachBatch(lambda df, epoch, out=out: df.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")).option("checkpointLocation", scratch(spark, "mark")).trigger(processingTime=every).start()
        while q.isActive and q.lastProgress is None:  # the first batch starts at once, the next after the period
            time.sleep(0.2)
        failed = q.exception()
        q.stop()
        if failed is not None:
            raise failed
        rows = spark.read.schema("id long").option("recursiveFileLookup", True).parquet(out)
        counts.append(rows.agg(F.lit(worker).alias("worker"), F.lit(every).alias("every"), F.count("*").alias("n")))
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3])


@query(f"WITH {P.SQL_ARRIVALS} SELECT id, count(*) OVER (PARTITION BY source_id ORDER BY published_at RANGE BETWEEN INTERVAL 48 HOUR PRECEDING AND CURRENT ROW) AS recent FROM arrivals")
def st_window_48h(spark, sf):
    """For each article those of its source in the 48 hours up to it, counted as it comes in."""
    return replayed(spark, P.arrivals(spark, sf).select("id", "source_id", "published_at"), "published_at", lambda s: stateful.sliding_counts(s, "source_id"), "id long, recent long")


@query("SELECT queue, n FROM (SELECT 'cluster_work' AS queue, count(*) AS n FROM events WHERE event_type IN ('view', 'click') UNION ALL SELECT 'image_backfill', count(*) FROM events WHERE user_id % 3 = 0)", name="st_trigger_fanout")
@query("SELECT queue, n FROM (SELECT 'cluster_work' AS queue, count(*) AS n FROM events WHERE event_type IN ('view', 'click') UNION ALL SELECT 'image_backfill', count(*) FROM events WHERE user_id % 3 = 0)", name="snk_send")
def _fanned(spark, sf):
    out, mark = scratch(spark, "queues"), scratch(spark, "mark")
    politics = F.when(F.col("event_type").isin("view", "click"), "politika").otherwise("spor")
    s = _stream(spark, sf).select("id", politics.alias("category"), F.when(F.col("user_id") % 3 != 0, "https://i.example/").alias("image_url"))
    queues.drain(s, queues.fan_out_batch(out), mark).awaitTermination()
    read = lambda n: spark.read.schema("message string").option("recursiveFileLookup", True).parquet(f"{out}/{n}").agg(F.lit(n).alias("queue"), F.count("*").alias("n"))
    return read("cluster_work").unionByName(read("image_backfill"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 4 <> 1")
def snk_delete(spark, sf):
    """The orders that stay when those of a list of keys go."""
    o = P.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return delete_cascade(o, o.filter("o_orderkey % 4 = 1"), "o_orderkey")


@query()
def st_token_bucket(spark, sf):
    r = P.table(spark, sf, "events").select(F.col("user_id").alias("client"), F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return token_bucket(r, capacity=5, refill=1 / 3600)


@query()
def st_token_bucket_stream(spark, sf):
    """Each event asks one of the four limits, by its type and user; buckets live on while the log comes in slices."""
    at = F.timestamp_micros((F.unix_micros(F.col("ts").cast("timestamp")) / 64).cast("long"))  # a log 64 times as dense, so that there are refusals
    names = sorted(stateful.LIMITS)
    limit = F.element_at(F.array(*map(F.lit, names)), (F.pmod(F.xxhash64("event_type"), F.lit(len(names))) + 1).cast("int"))
    r = P.table(spark, sf, "events").select(limit.alias("limit"), (F.col("user_id") % 8).cast("string").alias("client"), F.col("event_id").alias("seq"), at.alias("time"))
    return replayed(spark, r, "time", lambda s: stateful.token_buckets(s, stateful.LIMITS), "limit string, client string, seq long, allowed boolean, retry_after_ms long")


@query()
def fn_retry_after(spark, sf):
    r = P.table(spark, sf, "events").select(F.lit("all").alias("client"), F.col("event_id").alias("seq"), (F.col("event_id") / 10).alias("at"))
    one_day = r.withColumn("client", (F.col("seq") % 64).cast("string"))
    return token_bucket(one_day, capacity=5, refill=0.1).filter("not allowed").groupBy("client").agg(F.max("retry_after_ms").alias("longest"), F.count("*").alias("refused"))


@query("SELECT event_id AS job, event_id % 16 AS worker, coalesce(sum(event_id % 7) OVER w, 0) AS start, coalesce(sum(event_id % 7) OVER w, 0) <= 50 AS ran FROM events WINDOW w AS (PARTITION BY event_id % 16 ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def st_concurrency_pool(spark, sf):
    """Sixteen workers and a deadline after 50 seconds; job seconds are given."""
    return pool(P.table(spark, sf, "events").select(F.col("event_id").alias("job"), (F.col("event_id") % 7).alias("seconds")), 16, 50)


@query("""WITH r AS (SELECT event_type AS key, event_id AS seq, epoch_us(ts) / 1000000.0 AS s, user_id % 10 = 0 AS inv FROM events), p AS (SELECT *, sum(CAST(inv AS INTEGER)) OVER (PARTITION BY key ORDER BY s, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS epoch FROM r)
SELECT key, seq, row_number() OVER (PARTITION BY key, floor(s / 3600), epoch ORDER BY s, seq) > 1 AS hit FROM p""")
def st_cache_ttl(spark, sf):
    """Reads of a view that lives for an hour and is built anew when its tag is invalidated."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return cached_reads(P.table(spark, sf, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("seq"), at.alias("at"), (F.col("user_id") % 10 == 0).alias("invalidates")), 3600)


@query("SELECT count(*) AS n, CAST(sum(x) AS BIGINT) AS total FROM (SELECT l_linenumber * 2 AS x FROM lineitem)")
def udf_sql_fn(spark, sf):
    """A SQL function of the session, applied in a plan."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION twice(x INT) RETURNS INT RETURN x * 2")
    P.table(spark, sf, "lineitem").createOrReplaceTempView("lineitem_for_twice")
    return spark.sql("SELECT count(*) AS n, sum(twice(l_linenumber)) AS total FROM lineitem_for_twice")
