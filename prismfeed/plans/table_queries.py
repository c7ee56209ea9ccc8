"""Scans, filters, joins, set operations, deduplication and updates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from prismfeed.functions import clean, scalar
from prismfeed.operators import hygiene as H
from prismfeed.operators import operations as O
from prismfeed.operators import views as V
from prismfeed.plans import proxy as P
from prismfeed.plans.registry import query
from prismfeed.sources import landed
from prismfeed.staging import scratch, staged

NOW = P.SQL_AS_OF
stamp_sql = lambda c: f"strftime({c}, '%Y-%m-%d %H:%M:%S')"

# ---- scans ----------------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def src_table_scan(spark, sf):
    return P.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey AS id, o_orderstatus AS status FROM orders")
def prj_columns(spark, sf):
    return P.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))


@query(f"WITH {P.SQL_SOURCES} SELECT id, slug FROM sources WHERE active ORDER BY slug")
def src_active_sources(spark, sf):
    return P.sources(spark).filter("active").orderBy("slug").select("id", "slug")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey = 7")
def src_pk_lookup(spark, sf):
    return P.table(spark, sf, "orders").filter("o_orderkey = 7").select("o_orderkey", "o_totalprice").limit(1)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT event_id * 3 FROM events)")
def src_in_chunked(spark, sf):
    keys = P.table(spark, sf, "events").select((F.col("event_id") * 3).alias("o_orderkey"))
    return P.table(spark, sf, "orders").join(keys, "o_orderkey", "left_semi").select("o_orderkey", "o_totalprice")


# ---- projections and filters ----------------------------------------------------------------------------------------------


@query(f"WITH {P.SQL_CLUSTERS} SELECT id, CASE WHEN length(trim(title_tr_neutral)) > 0 THEN title_tr_neutral ELSE title_tr END AS title FROM clusters")
def prj_coalesce_title(spark, sf):
    from prismfeed.operators.serving import display_title

    return P.clusters(spark, sf).select("id", display_title(F.col("title_tr_neutral"), F.col("title_tr")).alias("title"))


@query("SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN ' ' ELSE trim(props) END AS summary FROM events")
def prj_summary_fallback(spark, sf):
    e = P.table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.concat(F.lit(" "), "props")).otherwise("  ").alias("d"))
    text = clean.trim_blanks(F.col("d"))
    return e.select(F.col("event_id").alias("id"), F.when(F.length(text) > 0, text).otherwise(" ").alias("summary"))


@query(f"WITH {P.SQL_SOURCES} SELECT id, coalesce(logo_url, 'https://www.google.com/s2/favicons?domain=' || regexp_replace(url, '^https?://(www\\.)?([^/]+).*$', '\\2') || '&sz=64') AS logo_url FROM sources")
def prj_logo_url(spark, sf):
    return P.sources(spark).select("id", clean.logo_url(F.col("logo_url"), F.col("url")).alias("logo_url"))


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def flt_eq(spark, sf):
    return P.table(spark, sf, "orders").filter("o_orderstatus = 'F'").agg(F.count("*").alias("n"))


@query(f"WITH {P.SQL_MEMBERS} SELECT count(*) FILTER (content_hash IS NULL) AS missing, count(*) FILTER (content_hash <> '2') AS other FROM members")
def flt_neq_null(spark, sf):
    h = F.col("content_hash")
    return P.members(spark, sf).agg(F.count_if(h.isNull()).alias("missing"), F.count_if(h != "2").alias("other"))


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1997-03-01' AND o_totalprice > 1000")
def flt_range(spark, sf):
    return P.table(spark, sf, "orders").filter("o_orderdate >= timestamp_ntz'1997-01-01' and o_orderdate < timestamp_ntz'1997-03-01' and o_totalprice > 1000").select("o_orderkey")


@query("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1")
def flt_in(spark, sf):
    return P.table(spark, sf, "lineitem").filter(F.col("l_returnflag").isin("A", "R")).groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("SELECT page_id, 'https://base.example' || '/p/' || page_id AS url FROM pages WHERE page_id % 2 = 0")
def flt_like_prefix(spark, sf):
    u = P.table(spark, sf, "pages").select("page_id", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("/p/"), F.col("page_id").cast("string"))).otherwise(F.col("url")).alias("url"))
    return u.filter(F.col("url").startswith("/")).select("page_id", clean.absolute_url(F.col("url"), F.lit("https://base.example/")).alias("url"))


@query("SELECT page_id FROM pages WHERE regexp_matches(html, '&(amp|lt|gt|quot|apos|nbsp|#34|#39);')")
def flt_regex(spark, sf):
    return P.table(spark, sf, "pages").filter(F.col("html").rlike("&(amp|lt|gt|quot|apos|nbsp|#34|#39);")).select("page_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def flt_not_in_subquery(spark, sf):
    gone = P.table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return P.table(spark, sf, "orders").join(gone, "o_orderkey", "left_anti").select("o_orderkey")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(translate(p_name, 'İI', 'iı')), lower(translate('TIN', 'İI', 'iı'))) OR contains(lower(translate(p_name, 'İI', 'iı')), 'a')")
def flt_search_title(spark, sf):
    low = lambda c: F.lower(F.translate(c, "İI", "iı"))
    name = low(F.col("p_name"))
    return P.table(spark, sf, "part").filter(F.contains(name, low(F.lit("TIN"))) | F.contains(name, F.lit("a"))).select("p_partkey", "p_name")


@query("""WITH u AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN 'data:image/png;base64,xyz' WHEN 2 THEN 'https://x.example/favicon.ico' WHEN 3 THEN 'a.png' ELSE '/img/photo' || page_id || '.jpg' END AS u FROM pages)
SELECT page_id, length(u) >= 10 AND NOT starts_with(u, 'data:') AND NOT regexp_matches(u, '(?i)favicon|icon|logo|pixel|tracker|1x1|spacer') AS ok,
length(u) >= 10 AND NOT starts_with(u, 'data:') AND NOT regexp_matches(u, '(?i)favicon|icon|logo|pixel|tracker|1x1|spacer') AND regexp_matches(u, '(?i)^https?://') AS ok_absolute FROM u""")
def flt_valid_image(spark, sf):
    k = F.col("page_id") % 5
    u = F.when(k == 0, F.col("url")).when(k == 1, "data:image/png;base64,xyz").when(k == 2, "https://x.example/favicon.ico").when(k == 3, "a.png").otherwise(F.concat(F.lit("/img/photo"), F.col("page_id").cast("string"), F.lit(".jpg")))
    return P.table(spark, sf, "pages").select("page_id", clean.valid_image(u).alias("ok"), clean.valid_image(u, absolute=True).alias("ok_absolute"))


_MAIL = "CASE c_custkey % 4 WHEN 0 THEN ' User' || c_custkey || '@Example.org ' WHEN 1 THEN 'no-at.example' WHEN 2 THEN 'a b@c.d' ELSE 'x@y.z' END"


@query(f"SELECT c_custkey, length(lower(trim({_MAIL}))) <= 254 AND regexp_matches(lower(trim({_MAIL})), '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$') AS ok FROM customer")
def flt_email(spark, sf):
    return P.table(spark, sf, "customer").select("c_custkey", clean.valid_email(_mail()).alias("ok"))


def _mail():
    k = F.col("c_custkey") % 4
    return F.when(k == 0, F.concat(F.lit(" User"), F.col("c_custkey").cast("string"), F.lit("@Example.org "))).when(k == 1, "no-at.example").when(k == 2, "a b@c.d").otherwise("x@y.z")


@query(f"WITH {P.SQL_MEMBERS} SELECT 'cluster_work' AS queue, count(*) AS n FROM members WHERE category IN ('politika', 'son_dakika') UNION ALL SELECT 'image_backfill', count(*) FROM members WHERE image_url IS NULL")
def flt_enqueue_when(spark, sf):
    from prismfeed.streaming.queues import fan_out

    work, images = fan_out(P.members(spark, sf))
    count = lambda df, name: df.agg(F.lit(name).alias("queue"), F.count("*").alias("n"))
    return count(work, "cluster_work").unionByName(count(images, "image_backfill"))


_BLOCKS = ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "0.0.0.0/8", "100.64.0.0/10", "198.18.0.0/15", "192.0.0.0/24", "192.0.2.0/24", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4"]


def _block_values() -> str:
    import ipaddress

    rows = ((b, ipaddress.ip_network(b)) for b in _BLOCKS)
    return ", ".join(f"('{b}', {int(n.network_address)}, {int(n.broadcast_address)})" for b, n in rows)


@query(f"""WITH ips AS (SELECT event_id AS id, (event_id * 2654435761) % 4294967296 AS n FROM events), b AS (SELECT * FROM (VALUES {_block_values()}) t(label, lo, hi)) SELECT id, label FROM ips LEFT JOIN b ON n BETWEEN lo AND hi""")
def flt_private_ip(spark, sf):
    from prismfeed.functions.network import blocked_label

    n = (F.col("event_id") * 2654435761) % 4294967296
    ip = F.concat_ws(".", *[(F.shiftright(n, s) % 256).cast("string") for s in (24, 16, 8, 0)])
    return P.table(spark, sf, "events").select(F.col("event_id").alias("id"), blocked_label(ip).alias("label"))


# ---- joins ----------------------------------------------------------------------------------------------------------------


@query(f"WITH {P.SQL_MEMBERS}, {P.SQL_SOURCES} SELECT o_orderkey AS id, count(m.id) AS members, string_agg(m.id || '/' || s.name, ',' ORDER BY m.id, s.name) AS nested FROM orders LEFT JOIN members m ON m.cluster_id = o_orderkey LEFT JOIN sources s ON s.id = m.source_id GROUP BY 1")
def jn_embed_3hop(spark, sf):
    m = P.members(spark, sf).join(F.broadcast(P.sources(spark).select(F.col("id").alias("source_id"), "name")), "source_id", "left")  # thirty sources
    nested = m.groupBy("cluster_id").agg(F.count("*").alias("members"), F.array_sort(F.collect_list(F.struct("id", "name"))).alias("articles"))
    o = P.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    text = F.array_join(F.transform("articles", lambda a: F.concat(a["id"].cast("string"), F.lit("/"), a["name"])), ",")
    return o.join(nested, o.id == nested.cluster_id, "left").select("id", F.coalesce("members", F.lit(0)).alias("members"), text.alias("nested"))


@query(f"WITH {P.SQL_MEMBERS}, {P.SQL_SOURCES} SELECT m.id, name FROM members m JOIN sources s ON s.id = m.source_id WHERE cluster_id = 7")
def jn_detail_2hop(spark, sf):
    return P.members(spark, sf).filter("cluster_id = 7").join(P.sources(spark).select(F.col("id").alias("source_id"), "name"), "source_id").select("id", "name")


@query(f"WITH {P.SQL_MEMBERS}, {P.SQL_SOURCES} SELECT s.slug, count(*) AS n FROM orders JOIN members m ON m.cluster_id = o_orderkey JOIN sources s ON s.id = m.source_id GROUP BY 1")
def jn_inner_equi_sql(spark, sf):
    o = P.table(spark, sf, "orders").select(F.col("o_orderkey").alias("cluster_id"))
    return o.join(P.members(spark, sf), "cluster_id").join(P.sources(spark).select(F.col("id").alias("source_id"), "slug"), "source_id").groupBy("slug").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, coalesce(n, -1) AS n FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_quantity > 30 GROUP BY 1) ON l_orderkey = o_orderkey")
def jn_update_from(spark, sf):
    facts = P.table(spark, sf, "lineitem").filter("l_quantity > 30").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    return P.table(spark, sf, "orders").select("o_orderkey").join(facts, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(-1)).alias("n"))


@query("SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l_quantity > 40)")
def jn_delete_using(spark, sf):
    losers = P.table(spark, sf, "lineitem").filter("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"))
    return H.delete_cascade(P.table(spark, sf, "orders").select("o_orderkey"), losers, "o_orderkey")


@query(f"WITH {P.SQL_SOURCES} SELECT n_nationkey AS story, s.id AS source_id, v.stance FROM nation CROSS JOIN (VALUES ('src1', 'for'), ('src2', 'against'), ('src99', 'neutral')) v(slug, stance) JOIN sources s ON s.slug = v.slug")
def jn_lateral_values(spark, sf):
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("slug"), F.lit(b).alias("stance")) for a, b in (("src1", "for"), ("src2", "against"), ("src99", "neutral"))]))
    s = P.sources(spark).select("slug", F.col("id").alias("source_id"))
    return P.table(spark, sf, "nation").select(F.col("n_nationkey").alias("story"), rows.alias("v")).select("story", "v.slug", "v.stance").join(s, "slug").select("story", "source_id", "stance")


@query(f"WITH {P.SQL_ARRIVALS}, {P.SQL_SOURCES} SELECT a.id, s.slug, s.bias FROM arrivals a JOIN sources s ON s.id = a.source_id")
def jn_map_lookup(spark, sf):
    s = P.sources(spark).select(F.col("id").alias("source_id"), "slug", F.col("bias").alias("b"))
    return P.arrivals(spark, sf).join(F.broadcast(s), "source_id").select("id", "slug", F.col("b").alias("bias"))


@query(f"WITH {P.SQL_SOURCES} SELECT s.id, factuality FROM sources s LEFT JOIN (VALUES ('src1', 'high'), ('src2', 'mixed'), ('src3', 'low')) v(slug, factuality) ON v.slug = s.slug")
def jn_metadata_left(spark, sf):
    meta = spark.createDataFrame([("src1", "high"), ("src2", "mixed"), ("src3", "low")], "slug string, factuality string")
    return P.sources(spark).join(F.broadcast(meta), "slug", "left").select("id", "factuality")


# ---- sets -----------------------------------------------------------------------------------------------------------------


@query("SELECT count(*) AS n FROM (SELECT DISTINCT l_orderkey FROM lineitem)")
def set_distinct_ids(spark, sf):
    return P.table(spark, sf, "lineitem").select("l_orderkey").distinct().agg(F.count("*").alias("n"))


@query("SELECT user_id, event_type AS item FROM events GROUP BY 1, 2 HAVING count(*) % 2 = 1")
def set_toggle(spark, sf):
    return P.table(spark, sf, "events").groupBy("user_id", F.col("event_type").alias("item")).agg(F.count("*").alias("n")).filter("n % 2 = 1").drop("n")


@query("SELECT doc_id, len(list_intersect(list_distinct(string_split(lower(text), ' ')), ['the', 'and', 'der', 'que'])) AS shared FROM documents")
def set_intersect_size(spark, sf):
    words = F.split(F.lower("text"), " ")
    return P.table(spark, sf, "documents").select("doc_id", F.size(F.array_intersect(words, F.array(*map(F.lit, ("the", "and", "der", "que"))))).cast("long").alias("shared"))


# ---- deduplication, upserts and DML ---------------------------------------------------------------------------------------


@query(f"WITH {P.SQL_MEMBERS}, {P.SQL_FIRST.format(src='members')} SELECT cluster_id, source_id, id FROM deduped")
def win_dedupe_cluster_source(spark, sf):
    return H.keep_first(P.members(spark, sf), ["cluster_id", "source_id"], [F.asc_nulls_last("published_at"), "id"]).select("cluster_id", "source_id", "id")


@query(f"WITH {P.SQL_MEMBERS} SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY source_id, content_hash ORDER BY published_at, id) AS rn FROM members WHERE content_hash IS NOT NULL) WHERE rn = 1 UNION ALL SELECT id FROM members WHERE content_hash IS NULL")
def win_dedupe_source_hash(spark, sf):
    return H.keep_first(P.members(spark, sf), ["source_id", "content_hash"], ["published_at", "id"], unless=F.col("content_hash").isNull()).select("id")


@query(f"WITH {P.SQL_RECENT}, {P.SQL_FIRST.format(src='recent')} SELECT cluster_id, string_agg(id, ',' ORDER BY published_at DESC, id DESC) AS ids FROM deduped GROUP BY 1")
def win_first_per_source(spark, sf):
    from prismfeed.operators.serving import first_per_source

    rows = F.array_sort(F.collect_list(F.struct((-F.unix_micros("published_at")).alias("t"), (-F.col("id")).alias("i"))))
    return first_per_source(P.recent(spark, sf)).groupBy("cluster_id").agg(F.array_join(F.transform(rows, lambda x: (-x["i"]).cast("string")), ",").alias("ids"))


@query(f"""WITH {P.SQL_RECENT}, p AS (SELECT * FROM recent WHERE category IN ('politika', 'son_dakika')), s AS (SELECT cluster_id, arg_min(id, (published_at, id)) AS seed FROM p GROUP BY 1)
SELECT p.cluster_id, any_value(seed) AS seed, CAST(arg_max(id, (published_at, id)) FILTER (id <> seed) AS VARCHAR) AS latest FROM p JOIN s ON s.cluster_id = p.cluster_id GROUP BY 1""")
def win_seed_latest(spark, sf):
    p = P.recent(spark, sf).filter(F.col("category").isin("politika", "son_dakika"))
    two = p.groupBy("cluster_id").agg(F.min(F.struct("published_at", "id")).alias("a"), F.max(F.struct("published_at", "id")).alias("b"))
    latest = F.col("b.id")
    return two.select("cluster_id", F.col("a.id").alias("seed"), F.when(latest != F.col("a.id"), latest).cast("string").alias("latest"))


@query(f"WITH {P.SQL_ARRIVALS} SELECT source_id, min(id) AS id FROM arrivals GROUP BY source_id, event_type")
def win_first_seen_intra_cycle(spark, sf):
    return H.keep_first(P.arrivals(spark, sf), ["source_id", "event_type"], ["id"]).select("source_id", "id")


_SQL_UPSERT = """WITH b AS (SELECT event_id AS seq, 'u' || (event_id * 7 // 5) AS url, user_id % 30 AS source_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(event_id * 3 AS VARCHAR) END AS content_hash FROM events),
t AS (SELECT 'u' || (o_orderkey * 3) AS url, o_orderkey % 30 AS source_id, CAST(o_orderkey AS VARCHAR) AS content_hash FROM orders),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq) AS rn FROM b) WHERE rn = 1),
g AS (SELECT seq, url, source_id, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY source_id, content_hash ORDER BY seq) AS rn2 FROM f) WHERE rn2 = 1 OR content_hash IS NULL)
SELECT seq, url FROM g WHERE url NOT IN (SELECT url FROM t) AND NOT EXISTS (SELECT 1 FROM t WHERE t.source_id = g.source_id AND t.content_hash = g.content_hash)"""


@query(_SQL_UPSERT)
def snk_upsert_ignore(spark, sf):
    e = P.table(spark, sf, "events")
    b = e.select(F.col("event_id").alias("seq"), F.concat(F.lit("u"), F.floor(F.col("event_id") * 7 / 5).cast("string")).alias("url"), (F.col("user_id") % 30).alias("source_id"), F.when(F.col("event_id") % 9 != 0, (F.col("event_id") * 3).cast("string")).alias("content_hash"))
    k = F.col("o_orderkey")
    t = P.table(spark, sf, "orders").select(F.concat(F.lit("u"), (k * 3).cast("string")).alias("url"), (k % 30).alias("source_id"), k.cast("string").alias("content_hash"))
    return H.upsert_ignore(t, b).select("seq", "url")


@query("WITH u AS (SELECT user_id AS k, value AS v, event_id AS version FROM events UNION ALL SELECT c_custkey, c_acctbal, -1 FROM customer) SELECT k, arg_max(v, version) AS v, max(version) AS version FROM u GROUP BY 1")
def snk_upsert_update(spark, sf):
    old = P.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.lit(-1).cast("long").alias("version"))
    new = P.table(spark, sf, "events").select(F.col("user_id").alias("k"), F.col("value").alias("v"), F.col("event_id").alias("version"))
    return H.upsert_update(old, new, "k", "version")


@query("WITH o AS (SELECT DISTINCT l_orderkey AS c, l_linenumber AS a FROM lineitem WHERE l_quantity < 30), n AS (SELECT DISTINCT l_orderkey AS c, l_linenumber AS a FROM lineitem WHERE l_quantity > 25) SELECT c AS cluster_id, a AS article_id, NOT bool_or(k) AS inserted FROM (SELECT *, TRUE AS k FROM o UNION ALL SELECT *, FALSE FROM n) GROUP BY 1, 2")
def snk_atomic_link(spark, sf):
    line = P.table(spark, sf, "lineitem")
    pair = lambda where: line.filter(where).select(F.col("l_orderkey").alias("cluster_id"), F.col("l_linenumber").alias("article_id"))
    return H.link(pair("l_quantity < 30"), pair("l_quantity > 25"))


_SQL_VIEW = """, counted AS (SELECT cluster_id, bias, count(*) AS n, min(published_at) AS p, max(stamp) AS stamp FROM {src} GROUP BY 1, 2)
SELECT cluster_id, CAST(sum(n) AS BIGINT) AS article_count, string_agg(bias || ':' || n, ',' ORDER BY bias) AS distribution, count(*) = 1 AS is_blindspot, CASE WHEN count(*) = 1 THEN max(bias) END AS blindspot_side,
  strftime(min(p), '%Y-%m-%d %H:%M:%S') AS first_published, strftime(max(stamp), '%Y-%m-%d %H:%M:%S') AS updated_at FROM counted GROUP BY 1"""


def _shown(clusters):
    """Aggregates in plain columns."""
    d = F.array_sort(F.map_entries("bias_distribution"))
    text = F.array_join(F.transform(d, lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return clusters.select("cluster_id", "article_count", text.alias("distribution"), "is_blindspot", "blindspot_side", P.stamp("first_published").alias("first_published"), P.stamp("updated_at").alias("updated_at"))


@query(f"WITH {P.SQL_RECENT}, r AS (SELECT *, {P.SQL_AS_OF} + to_minutes(CAST(greatest(id % 4, CASE WHEN id % 3 = 0 THEN 3 ELSE 0 END) AS INTEGER)) AS stamp FROM recent)" + _SQL_VIEW.format(src="r"))
def snk_atomic_link_view(spark, sf):
    """Links in four batches, a third of them once more in the last one, and the third batch delivered twice: aggregates of the touched clusters follow each batch."""
    r = staged(P.recent(spark, sf).select("cluster_id", F.col("id").alias("article_id"), "bias", "published_at"), "links")  # ids are digests: made once, not for every batch
    view, deal = V.LinkedClusters(spark, scratch(spark, "view")).create(), F.col("article_id") % 4
    for epoch in (0, 1, 2, 2, 3):
        batch = r.filter((deal == epoch) | (F.col("article_id") % 3 == 0) if epoch == 3 else deal == epoch)
        view.apply(batch, epoch, F.timestamp_micros(F.unix_micros(P.as_of()) + epoch * 60_000_000))
    return _shown(view.clusters())


@query(f"WITH {P.SQL_RECENT}, kept AS (SELECT *, {P.SQL_AS_OF} AS stamp FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id, source_id ORDER BY published_at, id) AS rn FROM recent) WHERE rn = 1)" + _SQL_VIEW.format(src="kept"))
def snk_dedupe_recompute(spark, sf):
    """The repair: one article of each source in a cluster stays, then every aggregate is taken anew from what stays."""
    _, clusters = V.repair(P.recent(spark, sf).withColumn("article_id", F.col("id")), ["published_at", "id"], P.as_of())
    return _shown(clusters)


_SQL_OUTCOME = "CASE WHEN event_id % 50 = 0 THEN 'malformed' WHEN {worn} THEN 'poison' WHEN event_type = 'error' THEN 'retry' ELSE 'done' END"


def _leased(spark, sf):
    message = F.when(F.col("event_id") % 50 != 0, F.concat(F.lit('{"article_id": "a'), F.col("event_id").cast("string"), F.lit('"}'))).otherwise('{"article_id": 5}')
    return P.table(spark, sf, "events").select(F.col("event_id").alias("msg_id"), (F.col("event_id") % 6).cast("int").alias("read_ct"), "event_type", message.alias("message"))


@query(f"SELECT event_id AS msg_id, {_SQL_OUTCOME.format(worn='event_type = ' + chr(39) + 'error' + chr(39) + ' AND event_id % 6 > 3')} AS cluster_outcome, {_SQL_OUTCOME.format(worn='event_id % 6 > 3')} AS image_outcome FROM events")
def st_poison(spark, sf):
    """Clustering tells poison after a failure, the image search before its work."""
    m, failed = _leased(spark, sf), F.col("event_type") == "error"
    after = O.settle(m, failed, article_id(F.col("message"))).withColumnRenamed("outcome", "cluster_outcome")
    return O.settle(after, failed, article_id(F.col("message")), before_work=True).select("msg_id", "cluster_outcome", F.col("outcome").alias("image_outcome"))


_SQL_ARCHIVED = f"SELECT msg_id, read_ct, message, outcome, '2024-01-31 00:00:00' AS archived_at FROM (SELECT event_id AS msg_id, event_id % 6 AS read_ct, CASE WHEN event_id % 50 <> 0 THEN '{{\"article_id\": \"a' || event_id || '\"}}' ELSE '{{\"article_id\": 5}}' END AS message, {_SQL_OUTCOME.format(worn='event_type = ' + chr(39) + 'error' + chr(39) + ' AND event_id % 6 > 3')} AS outcome FROM events) WHERE outcome <> 'retry'"


@query(_SQL_ARCHIVED)
def snk_archive(spark, sf):
    """The archive as written, with the messages as they were."""
    rows, _ = O.archive(O.settle(_leased(spark, sf), F.col("event_type") == "error", article_id(F.col("message"))), P.as_of())
    return staged(rows, "archive").select("msg_id", "read_ct", "message", "outcome", P.stamp("archived_at").alias("archived_at"))


@query(_SQL_ARCHIVED)
def snk_archive_whole(spark, sf):
    """The same rows through a sink of our own: they are there when all tasks have written, not before."""
    landed.register(spark)
    rows, _ = O.archive(O.settle(_leased(spark, sf), F.col("event_type") == "error", article_id(F.col("message"))), P.as_of())
    path = scratch(spark, "archive")
    rows = rows.select("msg_id", "read_ct", "message", "outcome", "archived_at")
    rows.write.format("whole_archive").option("path", path).mode("append").save()
    kept = spark.read.format("whole_archive").schema(rows.schema).option("path", path).load()
    return kept.select("msg_id", "read_ct", "message", "outcome", P.stamp("archived_at").alias("archived_at"))


def article_id(message):
    """The article id of a message, null unless it is a string."""
    return F.when(F.get_json_object(message, "$.article_id").isNotNull() & message.rlike('"article_id"\\s*:\\s*"'), F.get_json_object(message, "$.article_id"))


@query("SELECT event_id AS id, CASE WHEN event_id % 50 = 0 THEN NULL ELSE 'a' || event_id END AS article_id FROM events")
def fn_json_article_id(spark, sf):
    m = F.when(F.col("event_id") % 50 != 0, F.concat(F.lit('{"article_id": "a'), F.col("event_id").cast("string"), F.lit('"}'))).otherwise('{"article_id": 5}')
    return P.table(spark, sf, "events").select(F.col("event_id").alias("id"), article_id(m).alias("article_id"))


@query("SELECT o_orderkey AS article_id, CASE WHEN o_orderkey % 3 = 0 THEN 'i' || o_orderkey END AS image_url, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 6 + 1 END AS attempts, CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 6 + 1 >= 5 THEN '2024-02-07 00:00:00' ELSE '2024-01-31 00:00:00' END AS attempted_at FROM orders")
def st_image_attempts(spark, sf):
    k = F.col("o_orderkey")
    o = P.table(spark, sf, "orders")
    state = o.select(k.alias("article_id"), F.lit(None).cast("string").alias("image_url"), (k % 6).alias("attempts"), F.lit(None).cast("timestamp").alias("attempted_at"), F.lit(True).alias("tried"))
    found = o.filter(k % 3 == 0).select(k.alias("article_id"), F.concat(F.lit("i"), k.cast("string")).alias("found"))
    out = O.image_attempts(state, found, P.as_of())
    return out.select("article_id", "image_url", "attempts", P.stamp("attempted_at").alias("attempted_at"))


@query("SELECT 'orders' AS name, o_orderstatus AS kind, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 2 UNION ALL SELECT 'lineitem', l_returnflag, count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'F' GROUP BY 2")
def dml_nuke(spark, sf):
    """Clusters of one status are deleted, and with them the rows that link to them."""
    o = P.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("kind"))
    links = P.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_returnflag").alias("kind"))
    left = H.cascade_delete(o.filter("kind = 'F'"), {"orders": o, "lineitem": links}, "k")
    count = lambda name: left[name].groupBy("kind").agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "kind", "n")
    return count("orders").unionByName(count("lineitem"))


@query("SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 5 = 0 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def dml_partial_update(spark, sf):
    s = P.table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    patches = s.filter("s_suppkey % 5 = 0").select("s_suppkey", F.lit(None).cast("string").alias("s_name"), F.lit(0.0).alias("s_acctbal"))
    return H.patch(s, patches, "s_suppkey")


@query("SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 5 = 0 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier WHERE s_suppkey % 7 <> 3 UNION ALL SELECT c_custkey + 1000000, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE s_name END, c_acctbal FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey WHERE c_custkey % 2 = 0 OR c_custkey % 7 = 3 AND s_name IS NOT NULL")
def dml_source_crud(spark, sf):
    """Sources are deleted, patched and created; a name that a source still bears is not taken twice."""
    s = P.table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    patches = s.filter("s_suppkey % 5 = 0").select("s_suppkey", F.lit(None).cast("string").alias("s_name"), F.lit(0.0).alias("s_acctbal"))
    c = P.table(spark, sf, "customer").join(s.select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("taken")), "c_custkey", "left")
    name = F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(F.col("taken"))
    creates = c.select((F.col("c_custkey") + 1_000_000).alias("s_suppkey"), name.alias("s_name"), F.col("c_acctbal").alias("s_acctbal")).filter("s_name is not null")
    return H.crud(s, creates, patches, s.filter("s_suppkey % 7 = 3"), "s_suppkey", "s_name")


@query(f"WITH m AS (SELECT c_custkey, lower(trim({_MAIL})) AS e FROM customer) SELECT e AS email, min(c_custkey) AS first_key, count(*) > 1 AS already FROM m WHERE regexp_matches(e, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$') GROUP BY 1")
def dml_newsletter(spark, sf):
    c = P.table(spark, sf, "customer").filter(clean.valid_email(_mail())).select("c_custkey", F.lower(F.trim(_mail())).alias("email"))
    return c.groupBy("email").agg(F.min("c_custkey").alias("first_key"), (F.count("*") > 1).alias("already"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE o_orderstatus END AS original FROM orders")
def dml_backfill_const(spark, sf):
    given = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority"))
    return P.table(spark, sf, "orders").select("o_orderkey", F.coalesce(given, "o_orderstatus").alias("original"))


@query(f"WITH {P.SQL_MEMBERS} SELECT id FROM members WHERE image_url IS NULL AND category IN ('politika', 'son_dakika') ORDER BY CASE WHEN id % 3 = 0 THEN NULL ELSE published_at END NULLS FIRST, id LIMIT 50")
def srt_image_rotation(spark, sf):
    m = P.members(spark, sf).filter("image_url is null and category in ('politika', 'son_dakika')").withColumn("tried", F.when(F.col("id") % 3 != 0, F.col("published_at")))
    return m.orderBy(F.asc_nulls_first("tried"), "id").limit(50).select("id")


@query(f"WITH {P.SQL_MEMBERS} SELECT count(*) AS pairs FROM members a JOIN members b ON a.cluster_id = b.cluster_id AND a.id < b.id WHERE abs(epoch_us(a.published_at) - epoch_us(b.published_at)) <= 172800000000")
def jn_time_band(spark, sf):
    """Counted along each cluster's time, not by making the pairs: those with earlier times within the band, and those of one time."""
    at = P.members(spark, sf).groupBy("cluster_id", F.unix_micros("published_at").alias("t")).agg(F.count("*").alias("e"))
    before = Window.partitionBy("cluster_id").orderBy("t").rangeBetween(-48 * 3_600_000_000, -1)
    pairs = F.col("e") * F.coalesce(F.sum("e").over(before), F.lit(0)) + F.expr("e * (e - 1) div 2")
    return at.select(pairs.alias("p")).agg(F.coalesce(F.sum("p"), F.lit(0)).alias("pairs"))


@query(f"WITH {P.SQL_CLUSTERS} SELECT id, article_count FROM clusters WHERE updated_at >= (SELECT max(updated_at) FROM clusters) - INTERVAL 48 HOUR ORDER BY updated_at DESC, id DESC LIMIT 60")
def top_context_60(spark, sf):
    c = P.clusters(spark, sf)
    newest = c.agg(F.max("updated_at").alias("newest"))
    return c.join(F.broadcast(newest)).filter("updated_at >= newest - interval 48 hours").orderBy(F.desc("updated_at"), F.desc("id")).limit(60).select("id", "article_count")  # one row
