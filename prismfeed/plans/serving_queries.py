"""Feeds, blindspots, trends, timelines, directories and operational aggregates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from prismfeed.functions import clean, scalar
from prismfeed.operators import serving as S
from prismfeed.plans import proxy as P
from prismfeed.plans.registry import query
from prismfeed.schema import BIAS_KEYS, BIAS_ORDER, ZONES, in_politics, zone_of

R = lambda x: F.round(x, 9)
NOW = P.SQL_AS_OF

SQL_FEED = f"""WITH {P.SQL_CLUSTERS}, top AS (SELECT * FROM clusters WHERE article_count >= 2 ORDER BY updated_at DESC, id DESC LIMIT 200),
mine AS (SELECT r.* FROM recent r JOIN top ON top.id = r.cluster_id), {P.SQL_FIRST.format(src="mine")},
maj AS (SELECT cluster_id FROM mine GROUP BY 1 HAVING avg(CASE WHEN category IN ('politika', 'son_dakika') THEN 1 ELSE 0 END) >= 0.6),
w AS (SELECT cluster_id, count(*) AS n, count(DISTINCT {P.SQL_PSEUDO}) AS u, count(DISTINCT {P.sql_zone("bias")}) AS zones,
  count(*) FILTER (published_at >= {NOW} - INTERVAL 2 HOUR) AS v2, count(*) FILTER (published_at >= {NOW} - INTERVAL 24 HOUR) AS v24 FROM deduped GROUP BY 1),
bs AS (SELECT cluster_id, source_id, count(*) AS c FROM mine GROUP BY 1, 2),
tot AS (SELECT cluster_id, count(*) AS t FROM mine GROUP BY 1),
fair AS (SELECT bs.cluster_id, CAST(sum(least(c, greatest(1, (t + 9) // 10))) AS BIGINT) AS eff, count(*) FILTER (c > greatest(1, (t + 9) // 10)) AS capped FROM bs JOIN tot USING (cluster_id) GROUP BY 1),
dom AS (SELECT cluster_id, CASE WHEN max(c) * 1.0 / sum(c) > 0.6 THEN 1 ELSE 0 END AS dominance FROM (SELECT cluster_id, source_id, count(*) AS c FROM deduped GROUP BY 1, 2) GROUP BY 1),
bundles AS (SELECT top.id AS cluster_id, title_tr, title_tr_neutral, summary_tr, updated_at, first_published, n AS article_count, zones, eff, capped, dominance,
  CASE WHEN length(trim(title_tr_neutral)) > 0 THEN title_tr_neutral ELSE title_tr END AS title,
  n >= 3 AND u * 1.0 / n <= 0.5 AS is_wire, CASE WHEN n < 3 THEN n ELSE u END AS unique_hashes, CASE WHEN v24 > 0 THEN v2 * 1.0 / v24 ELSE 0 END AS velocity
  FROM top JOIN maj ON maj.cluster_id = top.id JOIN w ON w.cluster_id = top.id JOIN fair ON fair.cluster_id = top.id JOIN dom ON dom.cluster_id = top.id),
scored AS (SELECT *, log2(least(CASE WHEN is_wire THEN unique_hashes ELSE article_count END, eff) + 1) + 0.5 * log2(zones + 1)
  - 0.5 * (epoch_us({NOW}) - epoch_us(first_published)) / 3.6e9 / 6 - 0.2 * dominance + velocity AS score FROM bundles),
ranked AS (SELECT * FROM scored ORDER BY round(score, 9) DESC, updated_at DESC, cluster_id DESC LIMIT 30),
breaking AS (SELECT * FROM scored WHERE first_published > {NOW} - INTERVAL 2 HOUR ORDER BY first_published DESC, cluster_id DESC LIMIT 6)
"""


def feed(spark, sf):
    return S.feed_bundles(P.clusters(spark, sf), P.recent(spark, sf), P.as_of())


@query(SQL_FEED + "SELECT cluster_id, title, article_count, zones, eff AS effective, unique_hashes, is_wire, round(velocity, 9) AS velocity, round(score, 9) AS score FROM ranked")
def top_ranked_30(spark, sf):
    return S.ranked(feed(spark, sf)).select("cluster_id", "title", "article_count", "zones", "effective", "unique_hashes", "is_wire", R("velocity").alias("velocity"), R("score").alias("score"))


@query(SQL_FEED + "SELECT cluster_id, strftime(first_published, '%Y-%m-%d %H:%M:%S') AS first_published FROM breaking")
def top_breaking_6(spark, sf):
    return S.breaking(feed(spark, sf), P.as_of()).select("cluster_id", P.stamp("first_published").alias("first_published"))


@query(SQL_FEED + "SELECT cluster_id FROM ranked WHERE cluster_id NOT IN (SELECT cluster_id FROM breaking)")
def set_except_breaking(spark, sf):
    f = feed(spark, sf)
    return S.ranked(f).join(S.breaking(f, P.as_of()).select("cluster_id"), "cluster_id", "left_anti").select("cluster_id")


@query(SQL_FEED + "SELECT count(*) FILTER (capped > 0) AS capped_clusters, count(*) FILTER (dominance > 0) AS dominated_clusters FROM scored")
def agg_capped_diag(spark, sf):
    return feed(spark, sf).agg(F.count_if(F.size("capped") > 0).alias("capped_clusters"), F.count_if(F.col("dominance") > 0).alias("dominated_clusters"))


@query(SQL_FEED + "SELECT cluster_id, round(score, 9) AS score FROM scored")
def fn_log2_score(spark, sf):
    return feed(spark, sf).select("cluster_id", R("score").alias("score"))


@query(SQL_FEED + "SELECT cluster_id, dominance, round(velocity, 9) AS velocity, zones FROM scored", name="agg_velocity")
@query(SQL_FEED + "SELECT cluster_id, dominance, round(velocity, 9) AS velocity, zones FROM scored", name="agg_distinct_zones")
@query(SQL_FEED + "SELECT cluster_id, dominance, round(velocity, 9) AS velocity, zones FROM scored", name="agg_dominance")
def _fold(spark, sf):
    return feed(spark, sf).select("cluster_id", "dominance", R("velocity").alias("velocity"), "zones")


@query(SQL_FEED + "SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN first_published > TIMESTAMP '2024-01-31' - INTERVAL 24 HOUR THEN 'today' WHEN first_published > TIMESTAMP '2024-01-31' - INTERVAL 7 DAY THEN 'thisWeek' ELSE 'older' END AS bucket FROM ranked) GROUP BY 1")
def win_page_bucket(spark, sf):
    return S.ranked(feed(spark, sf)).groupBy(S.page_bucket(F.col("first_published"), P.as_of()).alias("bucket")).agg(F.count("*").alias("n"))


@query(
    SQL_FEED + "SELECT * FROM (SELECT cluster_id, CAST(row_number() OVER (ORDER BY round(score, 9) DESC, updated_at DESC, cluster_id DESC) AS INTEGER) AS place FROM ranked) WHERE place BETWEEN 16 AND 30"
)
def lim_pagination(spark, sf):
    w = Window.orderBy(F.desc(R("score")), F.desc("updated_at"), F.desc("cluster_id"))  # over the 30 of the feed
    return S.ranked(feed(spark, sf)).select("cluster_id", F.row_number().over(w).alias("place")).filter(F.col("place").between(16, 30))


_SQL_ITEMS = (
    SQL_FEED
    + """SELECT cluster_id, '<item><title>' || replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') || '</title><link>http://localhost:3000/cluster/' || cluster_id
 || '</link><guid isPermaLink="true">http://localhost:3000/cluster/' || cluster_id || '</guid><pubDate>' || strftime(first_published, '%a, %d %b %Y %H:%M:%S GMT') || '</pubDate><description>'
 || replace(replace(replace(article_count || ' kaynaktan haberler. ' || summary_tr[:240], '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</description></item>' AS item FROM ranked"""
)


@query(_SQL_ITEMS)
def snk_rss_xml(spark, sf):
    cols = [F.col(c) for c in ("cluster_id", "title", "article_count", "summary_tr", "first_published")]
    return S.ranked(feed(spark, sf)).select("cluster_id", S.rss_item(*cols, "http://localhost:3000", clean.escape_xml).alias("item"))


_RSS_HEAD = """<?xml version="1.0" encoding="UTF-8"?><rss version="2.0" xmlns:atom="http://www.w3.org/2005/Atom"><channel><title>Haber Analizi</title><link>http://localhost:3000/</link><atom:link href="http://localhost:3000/rss.xml" rel="self" type="application/rss+xml"/><description>Aynı haber, farklı kaynaklar.</description><language>tr-TR</language><lastBuildDate>Wed, 31 Jan 2024 00:00:00 GMT</lastBuildDate>"""


@query(_SQL_ITEMS.replace(" AS item FROM ranked", " AS item, row_number() OVER (ORDER BY round(score, 9) DESC, updated_at DESC, cluster_id DESC) AS place FROM ranked").replace("SELECT cluster_id, '<item>", ", items AS (SELECT cluster_id, '<item>", 1) + f") SELECT '{_RSS_HEAD}' || string_agg(item, '' ORDER BY place) || '</channel></rss>' AS document FROM items")
def snk_rss_document(spark, sf):
    """The whole document with its channel."""
    ranked = S.ranked(feed(spark, sf))
    cols = [F.col(c) for c in ("cluster_id", "title", "article_count", "summary_tr", "first_published")]
    items = ranked.select(S.rss_item(*cols, "http://localhost:3000", clean.escape_xml).alias("item"), R("score").alias("score"), "updated_at", "cluster_id")
    return S.rss_document(items, [F.desc("score"), F.desc("updated_at"), F.desc("cluster_id")], "Haber Analizi", "Aynı haber, farklı kaynaklar.", "http://localhost:3000", P.as_of())



@query(
    f"""WITH {P.SQL_CLUSTERS}, top AS (SELECT * FROM clusters WHERE article_count >= 2 ORDER BY updated_at DESC, id DESC LIMIT 1000),
hero AS (SELECT cluster_id, image_url, row_number() OVER (PARTITION BY cluster_id ORDER BY published_at DESC, recent.id DESC) AS rn FROM recent JOIN top ON top.id = cluster_id WHERE image_url IS NOT NULL)
SELECT 'http://localhost:3000/cluster/' || id AS url, image_url AS image, strftime(updated_at, '%Y-%m-%d %H:%M:%S') AS modified FROM top LEFT JOIN hero ON hero.cluster_id = top.id AND rn = 1
UNION ALL SELECT 'http://localhost:3000' || p, NULL, '2024-01-31 00:00:00' FROM (VALUES ('/'), ('/blindspots'), ('/sources')) t(p)"""
)
def snk_sitemap(spark, sf):
    top = S.latest(P.clusters(spark, sf), 1000)
    hero = P.recent(spark, sf).filter("image_url is not null").join(F.broadcast(top.select(F.col("id").alias("cluster_id"))), "cluster_id", "left_semi").groupBy("cluster_id").agg(F.max_by("image_url", F.struct("published_at", "id")).alias("image"))
    dynamic = top.join(hero, top.id == hero.cluster_id, "left").select(F.concat(F.lit("http://localhost:3000/cluster/"), F.col("id").cast("string")).alias("url"), "image", P.stamp("updated_at").alias("modified"))
    static = spark.createDataFrame([(f"http://localhost:3000{p}", None, P.AS_OF) for p in ("/", "/blindspots", "/sources")], "url string, image string, modified string")
    return static.unionByName(dynamic)


@query("SELECT url FROM (VALUES ('/'), ('/blindspots'), ('/sources')) t(url) UNION ALL SELECT '/cluster/' || o_orderkey FROM orders")
def set_union_routes(spark, sf):
    static = spark.createDataFrame([("/",), ("/blindspots",), ("/sources",)], "url string")
    return static.unionByName(P.table(spark, sf, "orders").select(F.concat(F.lit("/cluster/"), F.col("o_orderkey").cast("string")).alias("url")))


@query(
    f"""WITH {P.SQL_CLUSTERS}, m AS (SELECT cluster_id, list(DISTINCT 'Kaynak ' || source_id ORDER BY 'Kaynak ' || source_id)[:5] AS names FROM recent GROUP BY 1)
SELECT id, '{{"@type":"NewsArticle","headline":"' || title_tr || '","datePublished":"' || strftime(first_published, '%Y-%m-%d %H:%M:%S') || '","author":["' || array_to_string(names, '","') || '"]}}' AS doc FROM clusters JOIN m ON cluster_id = id"""
)
def snk_json_ld(spark, sf):
    names = P.recent(spark, sf).groupBy("cluster_id").agg(F.slice(F.array_sort(F.collect_set(F.concat(F.lit("Kaynak "), F.col("source_id").cast("string")))), 1, 5).alias("author"))
    c = P.clusters(spark, sf)
    doc = F.struct(F.lit("NewsArticle").alias("@type"), F.col("title_tr").alias("headline"), P.stamp("first_published").alias("datePublished"), "author")
    return c.join(names, c.id == names.cluster_id).select("id", F.to_json(doc).alias("doc"))


# ---- candidates, wire, fairness -------------------------------------------------------------------------------------------


@query(f"WITH {P.SQL_CLUSTERS} SELECT id, article_count FROM clusters WHERE article_count >= 2 ORDER BY updated_at DESC, id DESC LIMIT 200")
def top_candidates_200(spark, sf):
    return S.latest(P.clusters(spark, sf)).select("id", "article_count")


@query(f"WITH {P.SQL_RECENT}, {P.SQL_FIRST.format(src='recent')} SELECT cluster_id, count(*) AS n, CASE WHEN count(*) < 3 THEN count(*) ELSE count(DISTINCT {P.SQL_PSEUDO}) END AS unique_hashes, count(*) >= 3 AND count(DISTINCT {P.SQL_PSEUDO}) * 1.0 / count(*) <= 0.5 AS is_wire FROM deduped GROUP BY 1")
def agg_wire_detect(spark, sf):
    return S.wire(S.first_per_source(P.recent(spark, sf)))


@query(f"WITH {P.SQL_RECENT} SELECT cluster_id, count(DISTINCT {P.SQL_PSEUDO}) AS hashes FROM recent GROUP BY 1")
def agg_distinct_hash(spark, sf):
    return P.recent(spark, sf).groupBy("cluster_id").agg(F.countDistinct(S.pseudo_hash(F.col("content_hash"), F.col("id"))).alias("hashes"))


@query(f"""WITH {P.SQL_RECENT}, b AS (SELECT cluster_id, source_id, count(*) AS c, min(published_at) AS seen FROM recent GROUP BY 1, 2), t AS (SELECT *, sum(c) OVER (PARTITION BY cluster_id) AS total FROM b),
k AS (SELECT *, greatest(1, (total + 9) // 10) AS cap FROM t) SELECT cluster_id, CAST(sum(least(c, cap)) AS BIGINT) AS effective, count(*) FILTER (c > cap) AS capped FROM k GROUP BY 1""")
def agg_fairness_cap(spark, sf):
    return S.fairness(P.recent(spark, sf)).select("cluster_id", "effective", F.size("capped").cast("long").alias("capped"))


@query(f"WITH {P.SQL_RECENT} SELECT cluster_id, count(*) AS members FROM recent GROUP BY 1 HAVING avg(CASE WHEN category IN ('politika', 'son_dakika') THEN 1 ELSE 0 END) >= 0.6")
def flt_politics_majority(spark, sf):
    return S.politics_majority(P.recent(spark, sf)).select("cluster_id", "members")


@query(f"WITH {P.SQL_RECENT}, {P.SQL_FIRST.format(src='recent')} SELECT cluster_id, count(*) AS members FROM deduped GROUP BY 1 HAVING avg(CASE WHEN category IN ('politika', 'son_dakika') THEN 1 ELSE 0 END) >= 0.6")
def flt_politics_majority_post(spark, sf):
    return S.politics_majority(S.first_per_source(P.recent(spark, sf))).select("cluster_id", "members")


@query(f"WITH {P.SQL_RECENT}, {P.SQL_FIRST.format(src='recent')} SELECT cluster_id FROM deduped GROUP BY 1 HAVING avg(CASE WHEN category = 'dunya' THEN 1 ELSE 0 END) <= 0.5")
def flt_dunya_share(spark, sf):
    return S.first_per_source(P.recent(spark, sf)).groupBy("cluster_id").agg(F.avg((F.col("category") == "dunya").cast("int")).alias("d")).filter("d <= 0.5").select("cluster_id")


@query(f"WITH {P.SQL_CLUSTERS} SELECT id FROM clusters WHERE first_published < {NOW} - INTERVAL 24 HOUR")
def flt_age_delay(spark, sf):
    return P.clusters(spark, sf).filter(F.unix_micros("first_published") < F.unix_micros(P.as_of()) - 86_400_000_000).select("id")


@query(f"WITH {P.SQL_CLUSTERS} SELECT id, title_tr FROM clusters WHERE NOT regexp_matches(title_tr, '(?i)kimdir|nedir\\?|ne zaman|canlı|ne dedi')")
def flt_seo_title(spark, sf):
    return P.clusters(spark, sf).filter(~F.col("title_tr").rlike(clean.SEO_TITLE)).select("id", "title_tr")


SQL_BLIND = f"""WITH {P.SQL_CLUSTERS}, top AS (SELECT * FROM clusters WHERE article_count >= 3 AND first_published < {NOW} - INTERVAL 24 HOUR ORDER BY updated_at DESC, id DESC LIMIT 80),
mine AS (SELECT r.* FROM recent r JOIN top ON top.id = r.cluster_id), {P.SQL_FIRST.format(src="mine")},
f AS (SELECT cluster_id, count(*) AS n, count(DISTINCT {P.SQL_PSEUDO}) AS u, avg(CASE WHEN category = 'dunya' THEN 1 ELSE 0 END) AS d, avg(CASE WHEN category IN ('politika', 'son_dakika') THEN 1 ELSE 0 END) AS p,
  count(*) FILTER ({P.sql_zone("bias")} = 'iktidar') AS i, count(*) FILTER ({P.sql_zone("bias")} = 'muhalefet') AS m, count(*) FILTER ({P.sql_zone("bias")} = 'bagimsiz') AS b FROM deduped GROUP BY 1),
g AS (SELECT *, greatest(i, m, b) * 1.0 / n AS pct, CASE WHEN i = greatest(i, m, b) THEN 'iktidar' WHEN m = greatest(i, m, b) THEN 'muhalefet' ELSE 'bagimsiz' END AS zone FROM f),
kept AS (SELECT top.id AS cluster_id, updated_at, zone, pct, n FROM top JOIN g ON g.cluster_id = top.id WHERE title_tr NOT LIKE '%kimdir%' AND n >= 5 AND u * 1.0 / n >= 0.5 AND d <= 0.5 AND p >= 0.6 AND pct >= 0.8),
shown AS (SELECT * FROM kept ORDER BY updated_at DESC, cluster_id DESC LIMIT 30)
"""


def _blind(spark, sf):
    return S.blindspots(P.clusters(spark, sf), P.recent(spark, sf), P.as_of(), F.col("title_tr").rlike(clean.SEO_TITLE))


@query(SQL_BLIND + "SELECT cluster_id, zone AS dominant_zone, round(pct, 9) AS dominant_pct, n FROM shown")
def top_blindspot_limit_then_sort(spark, sf):
    return _blind(spark, sf).select("cluster_id", "dominant_zone", R("dominant_pct").alias("dominant_pct"), "n")


@query(SQL_BLIND + "SELECT cluster_id, zone <> coalesce(lag(zone) OVER (ORDER BY pct DESC, updated_at DESC, cluster_id DESC), '') AS divider FROM shown")
def win_prev_divider(spark, sf):
    w = Window.orderBy(F.desc("dominant_pct"), F.desc("updated_at"), F.desc("cluster_id"))  # over 30 rows
    return _blind(spark, sf).select("cluster_id", (F.col("dominant_zone") != F.coalesce(F.lag("dominant_zone").over(w), F.lit(""))).alias("divider"))


_SQL_COUNTS = f"""z AS (SELECT cluster_id, count(*) AS t, count(*) FILTER ({P.sql_zone("bias")} = 'iktidar') AS i, count(*) FILTER ({P.sql_zone("bias")} = 'bagimsiz') AS b, count(*) FILTER ({P.sql_zone("bias")} = 'muhalefet') AS m FROM recent GROUP BY 1)"""


def _cross_sql(threshold: float) -> str:
    return f"""WITH {P.SQL_RECENT}, {_SQL_COUNTS}, d AS (SELECT *, greatest(i, b, m) AS best, CASE WHEN i = greatest(i, b, m) THEN 'iktidar' WHEN b = greatest(i, b, m) THEN 'bagimsiz' ELSE 'muhalefet' END AS zone FROM z),
e AS (SELECT *, CASE zone WHEN 'iktidar' THEN m WHEN 'muhalefet' THEN i ELSE 0 END AS opp, best * 1.0 / t AS pct FROM d), f AS (SELECT *, t >= 5 AND pct >= {threshold} AND best - opp >= 3 AS fires FROM e)
SELECT cluster_id, CASE WHEN fires THEN zone END AS dominant_zone, CASE WHEN fires THEN round(pct, 9) ELSE 0 END AS dominant_pct, CASE WHEN fires THEN opp ELSE 0 END AS surprises, fires AND pct >= 0.85 AS blindspot_candidate FROM f"""


@query(_cross_sql(0.55))
def agg_cross_spectrum(spark, sf):
    return S.cross_spectrum(P.recent(spark, sf), 0.55).withColumn("dominant_pct", R("dominant_pct"))


@query(f"""WITH {P.SQL_RECENT}, {_SQL_COUNTS} SELECT cluster_id, CASE WHEN i = greatest(i, b, m) THEN 'iktidar' WHEN b = greatest(i, b, m) THEN 'bagimsiz' ELSE 'muhalefet' END AS dominant_zone, round(greatest(i, b, m) * 1.0 / t, 9) AS dominant_pct FROM z""")
def agg_dominant_zone(spark, sf):
    return S.dominant_zone(S.zone_counts(P.recent(spark, sf)), ZONES).select("cluster_id", "dominant_zone", R("dominant_pct").alias("dominant_pct"))


@query(f"""WITH {P.SQL_RECENT}, {_SQL_COUNTS} SELECT cluster_id, i AS iktidar, b AS bagimsiz, m AS muhalefet, floor(i * 100.0 / t + 0.5) AS iktidar_pct FROM z""")
def agg_zone_rollup(spark, sf):
    return S.zone_counts(P.recent(spark, sf)).select("cluster_id", *ZONES, scalar.js_round(F.col("iktidar") * 100.0 / F.col("total")).alias("iktidar_pct"))


@query(f"""WITH {P.SQL_RECENT}, {_SQL_COUNTS}, n AS (SELECT cluster_id, min('Kaynak ' || source_id) AS name FROM recent WHERE {P.sql_zone("bias")} = 'muhalefet' GROUP BY 1)
SELECT cluster_id, '⚡ ' || name || ' (muhalefet) bu iktidara yakın habere yer verdi: "Haber ' || cluster_id || '"' AS caption FROM z JOIN n USING (cluster_id) WHERE t >= 5 AND i * 1.0 / t >= 0.55 AND i - m >= 3""")
def fn_surprise_caption(spark, sf):
    m = P.recent(spark, sf)
    verdict = S.cross_spectrum(m, 0.55).filter("dominant_zone = 'iktidar' and surprises > 0")
    name = m.filter(zone_of(F.col("bias")) == "muhalefet").groupBy("cluster_id").agg(F.min(F.concat(F.lit("Kaynak "), F.col("source_id").cast("string"))).alias("name"))
    return verdict.join(name, "cluster_id").select("cluster_id", F.format_string('⚡ %s (muhalefet) bu iktidara yakın habere yer verdi: "Haber %d"', "name", "cluster_id").alias("caption"))


# ---- distributions --------------------------------------------------------------------------------------------------------


@query(f"WITH {P.SQL_RECENT} SELECT cluster_id, " + ", ".join(f"count(*) FILTER (bias = '{k}') AS {k}" for k in BIAS_KEYS) + " FROM recent GROUP BY 1")
def agg_bias_distribution(spark, sf):
    return P.recent(spark, sf).groupBy("cluster_id").agg(*[F.count_if(F.col("bias") == k).alias(k) for k in BIAS_KEYS])


@query(f"WITH {P.SQL_RECENT} SELECT cluster_id, count(DISTINCT bias) = 1 AS is_blindspot, CASE WHEN count(DISTINCT bias) = 1 THEN max(bias) END AS side FROM recent GROUP BY 1")
def agg_detect_blindspot(spark, sf):
    one = F.countDistinct("bias") == 1
    return P.recent(spark, sf).groupBy("cluster_id").agg(one.alias("is_blindspot"), F.when(one, F.max("bias")).alias("side"))


@query(f"""WITH {P.SQL_RECENT}, c AS (SELECT cluster_id, bias, count(*) AS n FROM recent GROUP BY 1, 2)
SELECT cluster_id, CAST(sum(n) AS BIGINT) AS article_count, string_agg(bias || ':' || n, ',' ORDER BY bias) AS distribution FROM c GROUP BY 1""")
def agg_cluster_recompute(spark, sf):
    c = P.recent(spark, sf).groupBy("cluster_id", "bias").agg(F.count("*").alias("n"))
    entries = F.transform(F.array_sort(F.collect_list(F.struct("bias", "n"))), lambda e: F.concat_ws(":", e["bias"], e["n"].cast("string")))
    return c.groupBy("cluster_id").agg(F.sum("n").alias("article_count"), F.array_join(entries, ",").alias("distribution"))


@query("SELECT event_id AS id, " + ", ".join(f"CASE WHEN event_id % 10 = {i} THEN event_id % 7 ELSE 0 END AS {k}" for i, k in enumerate(BIAS_KEYS)) + " FROM events")
def agg_normalize_distribution(spark, sf):
    """Sparse JSON counts, with unknown keys and no numbers, become ten dense ones."""
    key = F.element_at(F.array(*map(F.lit, BIAS_KEYS)), (F.col("event_id") % 10 + 1).cast("int"))
    raw = P.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.concat(F.lit('{"'), key, F.lit('": '), (F.col("event_id") % 7).cast("string"), F.lit(', "other": 3}')).alias("j"))
    counts = F.from_json("j", "map<string,double>")
    return raw.select("id", *[F.coalesce(F.when(~F.isnan(counts[k]), counts[k].cast("long")), F.lit(0).cast("long")).alias(k) for k in BIAS_KEYS])


@query(f"""WITH {P.SQL_RECENT}, k AS (SELECT DISTINCT cluster_id FROM recent), zz AS (SELECT * FROM (VALUES ('iktidar', 1), ('bagimsiz', 2), ('muhalefet', 3)) t(zone, place)),
c AS (SELECT cluster_id, {P.sql_zone("bias")} AS zone, count(*) AS n FROM recent GROUP BY 1, 2) SELECT k.cluster_id, zz.zone, place, coalesce(n, 0) AS n FROM k CROSS JOIN zz LEFT JOIN c ON c.cluster_id = k.cluster_id AND c.zone = zz.zone""")
def agg_cluster_stance(spark, sf):
    counts = S.zone_counts(P.recent(spark, sf))
    rows = F.explode(F.array(*[F.struct(F.lit(z).alias("zone"), F.lit(i).alias("place"), F.col(z).alias("n")) for i, z in enumerate(ZONES, 1)]))
    return counts.select("cluster_id", rows.alias("r")).select("cluster_id", "r.zone", "r.place", "r.n")


@query(f"""WITH {P.SQL_SOURCES}, {P.SQL_RECENT}, z AS (SELECT {P.sql_zone("bias")} AS zone, count(*) AS n FROM sources GROUP BY 1), c AS (SELECT DISTINCT cluster_id FROM recent), h AS (SELECT cluster_id, {P.sql_zone("sources.bias")} AS zone, count(DISTINCT source_id) AS participating FROM recent JOIN sources ON sources.id = source_id GROUP BY 1, 2)
SELECT c.cluster_id, z.zone, n, coalesce(participating, 0) AS participating, round(n / {P.N_SOURCES}.0, 9) AS share FROM c CROSS JOIN z LEFT JOIN h ON h.cluster_id = c.cluster_id AND h.zone = z.zone""")
def agg_media_dna(spark, sf):
    """For every cluster the sources of each zone and how many of them take part."""
    s = P.sources(spark).select(F.col("id").alias("source_id"), zone_of(F.col("bias")).alias("zone"))
    zones = s.groupBy("zone").agg(F.count("*").alias("n"))  # three rows
    taken = P.recent(spark, sf).select("cluster_id", "source_id").join(F.broadcast(s), "source_id").groupBy("cluster_id", "zone").agg(F.countDistinct("source_id").alias("participating"))
    by = taken.groupBy("cluster_id").agg(F.map_from_entries(F.collect_list(F.struct("zone", "participating"))).alias("by"))  # three entries
    each = by.select("cluster_id", "by", F.explode(F.array(*map(F.lit, ZONES))).alias("zone")).join(F.broadcast(zones), "zone")
    return each.select("cluster_id", "zone", "n", F.coalesce(F.element_at("by", F.col("zone")), F.lit(0)).alias("participating"), R(F.col("n") / F.lit(float(P.N_SOURCES))).alias("share"))


@query(f"""WITH {P.SQL_SOURCES}, {P.SQL_RECENT}, h AS (SELECT DISTINCT source_id FROM recent WHERE cluster_id = (SELECT min(cluster_id) FROM recent)) SELECT id, slug, source_id IS NOT NULL AS highlighted FROM sources LEFT JOIN h ON source_id = id""")
def jn_semi_highlight(spark, sf):
    """The sources, those of the first story marked."""
    r = P.recent(spark, sf)
    story = r.agg(F.min("cluster_id").alias("cluster_id"))  # one row
    slugs = r.join(F.broadcast(story), "cluster_id", "left_semi").select("source_id").distinct()
    s = P.sources(spark)
    return s.join(slugs, s.id == slugs.source_id, "left").select("id", "slug", F.col("source_id").isNotNull().alias("highlighted"))


# ---- trends, timeline, directory ------------------------------------------------------------------------------------------

SQL_DAILY = f"WITH {P.SQL_ARRIVALS}, daily AS (SELECT CAST(published_at AS DATE) AS day, {P.sql_zone('bias')} AS zone, count(*) AS count FROM arrivals GROUP BY 1, 2)"
SQL_GAP = SQL_DAILY + """, cal AS (SELECT CAST(d AS DATE) AS day FROM range(DATE '2024-01-02', DATE '2024-02-01', INTERVAL 1 DAY) t(d)), g AS (SELECT cal.day, coalesce(CAST(sum(count) FILTER (zone = 'iktidar') AS BIGINT), 0) AS iktidar, coalesce(CAST(sum(count) FILTER (zone = 'bagimsiz') AS BIGINT), 0) AS bagimsiz,
coalesce(CAST(sum(count) FILTER (zone = 'muhalefet') AS BIGINT), 0) AS muhalefet, coalesce(CAST(sum(count) AS BIGINT), 0) AS total FROM cal LEFT JOIN daily USING (day) GROUP BY 1)"""


@query(SQL_DAILY + " SELECT CAST(day AS VARCHAR) AS day, zone, count FROM daily")
def agg_trends_daily(spark, sf):
    return S.trends_daily(P.arrivals(spark, sf)).withColumn("day", F.col("day").cast("string"))


@query(SQL_DAILY + " SELECT CAST(day AS VARCHAR) AS day, zone, count FROM daily")
def st_tumbling_day_batch(spark, sf):
    a = P.arrivals(spark, sf)
    w = a.groupBy(F.window("published_at", "1 day"), zone_of(F.col("bias")).alias("zone")).agg(F.count("*").alias("count"))
    return w.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "zone", "count")


@query(SQL_GAP + " SELECT CAST(day AS VARCHAR) AS day, iktidar, bagimsiz, muhalefet, total FROM g")
def agg_gap_fill(spark, sf):
    return S.gap_filled(S.trends_daily(P.arrivals(spark, sf)), F.to_date(P.as_of())).withColumn("day", F.col("day").cast("string"))


@query(SQL_GAP + " SELECT greatest(1, max(total)) AS ymax, CAST(sum(total) AS BIGINT) AS total FROM g")
def agg_ymax_total(spark, sf):
    return S.gap_filled(S.trends_daily(P.arrivals(spark, sf)), F.to_date(P.as_of())).agg(F.greatest(F.lit(1), F.max("total")).alias("ymax"), F.sum("total").alias("total"))


@query(f"WITH {P.SQL_ARRIVALS} SELECT source_id, count(*) AS n, strftime(max(published_at), '%Y-%m-%d %H:%M:%S') AS latest FROM arrivals WHERE published_at >= {NOW} - INTERVAL 7 DAY GROUP BY 1")
def agg_source_activity(spark, sf):
    week = P.arrivals(spark, sf).filter(F.col("published_at") >= P.as_of() - F.expr("interval 7 days"))
    return week.groupBy("source_id").agg(F.count("*").alias("n"), P.stamp(F.max("published_at")).alias("latest"))


@query(f"WITH {P.SQL_SOURCES}, {P.SQL_ARRIVALS}, a AS (SELECT source_id, count(*) AS n FROM arrivals WHERE published_at >= {NOW} - INTERVAL 7 DAY AND source_id % 4 <> 0 GROUP BY 1) SELECT id, name, coalesce(n, 0) AS n FROM sources LEFT JOIN a ON source_id = id")
def jn_left_activity(spark, sf):
    a = P.arrivals(spark, sf).filter((F.col("published_at") >= P.as_of() - F.expr("interval 7 days")) & (F.col("source_id") % 4 != 0)).groupBy("source_id").agg(F.count("*").alias("n"))
    s = P.sources(spark)
    return s.join(a, s.id == a.source_id, "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("n"))


_SQL_RANK = "CASE bias " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(BIAS_ORDER)) + " END"


@query(f"WITH {P.SQL_SOURCES}, {P.SQL_ARRIVALS}, a AS (SELECT source_id, count(*) AS n FROM arrivals GROUP BY 1) SELECT id, CAST(row_number() OVER (ORDER BY {_SQL_RANK}, coalesce(n, 0) DESC, name) AS INTEGER) AS place FROM sources LEFT JOIN a ON source_id = id")
def srt_sources_bias(spark, sf):
    a = P.arrivals(spark, sf).groupBy("source_id").agg(F.count("*").alias("n"))
    s = P.sources(spark)
    rank = F.array_position(F.array(*map(F.lit, BIAS_ORDER)), F.col("bias"))
    w = Window.orderBy(rank, F.desc(F.coalesce("n", F.lit(0))), "name")  # thirty sources
    return s.join(a, s.id == a.source_id, "left").select("id", F.row_number().over(w).alias("place"))


@query(f"WITH {P.SQL_ARRIVALS} SELECT id, source_id FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY published_at DESC, id DESC) AS rn FROM arrivals) WHERE rn <= 20")
def top_recent_articles_20(spark, sf):
    """Twenty newest of each source: bounded heaps are merged, whatever a source's size."""
    a = P.arrivals(spark, sf)
    w = Window.partitionBy("source_id").orderBy(F.desc("published_at"), F.desc("id"))
    return a.select("id", "source_id", F.row_number().over(w).alias("rn")).filter("rn <= 20").drop("rn")


@query(f"WITH {P.SQL_CLUSTERS} SELECT id, strftime(first_published, '%Y-%m-%d %H:%M:%S') AS first_published, coalesce(title_tr_neutral, title_tr) AS title FROM clusters WHERE first_published > {NOW} - INTERVAL 24 HOUR ORDER BY clusters.first_published DESC, id DESC LIMIT 100")
def top_timeline_100(spark, sf):
    day = P.clusters(spark, sf).filter(F.col("first_published") > P.as_of() - F.expr("interval 24 hours"))
    top = day.orderBy(F.desc("first_published"), F.desc("id")).limit(100)
    return top.select("id", P.stamp("first_published").alias("first_published"), F.coalesce("title_tr_neutral", "title_tr").alias("title"))


@query(f"WITH {P.SQL_ARRIVALS} SELECT strftime(date_trunc('hour', published_at), '%Y-%m-%d %H:00') AS hour, strftime(date_trunc('hour', published_at) + INTERVAL 3 HOUR, '%H:00') AS istanbul, count(*) AS n FROM arrivals GROUP BY 1, 2")
def win_hour_bucket(spark, sf):
    hour = F.date_trunc("hour", "published_at")
    return P.arrivals(spark, sf).groupBy(F.date_format(hour, "yyyy-MM-dd HH:00").alias("hour"), F.date_format(hour + F.expr("interval 3 hours"), "HH:00").alias("istanbul")).agg(F.count("*").alias("n"))


@query(f"WITH {P.SQL_ARRIVALS} SELECT strftime(max(published_at), '%Y-%m-%d %H:%M:%S') AS latest FROM arrivals")
def top_latest_one(spark, sf):
    return P.arrivals(spark, sf).agg(P.stamp(F.max("published_at")).alias("latest"))


@query(f"WITH {P.SQL_CLUSTERS} SELECT strftime(min(first_published), '%Y-%m-%d %H:%M:%S') AS oldest FROM clusters WHERE title_tr_neutral IS NULL AND article_count >= 3")
def top_oldest_pending(spark, sf):
    return P.clusters(spark, sf).filter("title_tr_neutral is null and article_count >= 3").agg(P.stamp(F.min("first_published")).alias("oldest"))


_SQL_HEAD = f"""WITH {P.SQL_CLUSTERS}, top AS (SELECT id FROM clusters WHERE title_tr_neutral IS NULL AND article_count >= 3 ORDER BY article_count DESC, id LIMIT 5),
m AS (SELECT cluster_id, recent.id, row_number() OVER (PARTITION BY cluster_id ORDER BY published_at DESC, recent.id DESC) AS rn FROM recent JOIN top ON top.id = cluster_id)"""


def _headline_members(spark, sf):
    c = P.clusters(spark, sf).filter("title_tr_neutral is null and article_count >= 3")
    top = c.orderBy(F.desc("article_count"), "id").limit(5).select(F.col("id").alias("cluster_id"))
    w = Window.partitionBy("cluster_id").orderBy(F.desc("published_at"), F.desc("id"))
    return P.recent(spark, sf).join(F.broadcast(top), "cluster_id", "left_semi").withColumn("rn", F.row_number().over(w))


@query(_SQL_HEAD + " SELECT cluster_id, id FROM m WHERE rn <= 8")
def top_headline_5(spark, sf):
    return _headline_members(spark, sf).filter("rn <= 8").select("cluster_id", "id")


@query(_SQL_HEAD + " SELECT cluster_id, string_agg(rn || '. Başlık ' || id, chr(10) ORDER BY rn) AS prompt FROM m WHERE rn <= 8 GROUP BY 1")
def win_member_number(spark, sf):
    m = _headline_members(spark, sf).filter("rn <= 8")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rn", "id"))), lambda x: F.concat(x["rn"].cast("string"), F.lit(". Başlık "), x["id"].cast("string")))
    return m.groupBy("cluster_id").agg(F.array_join(lines, "\n").alias("prompt"))


@query(f"WITH {P.SQL_RECENT} SELECT cluster_id, array_to_string(list(id ORDER BY published_at DESC, id DESC)[:4], ',') AS visible, greatest(count(*) - 4, 0) AS extra FROM recent GROUP BY 1")
def lim_visible_4(spark, sf):
    order = F.array_sort(F.collect_list(F.struct((-F.unix_micros("published_at")).alias("t"), (-F.col("id")).alias("i"))))
    g = P.recent(spark, sf).groupBy("cluster_id").agg(order.alias("m"))
    return g.select("cluster_id", F.array_join(F.transform(F.slice("m", 1, 4), lambda x: (-x["i"]).cast("string")), ",").alias("visible"), F.greatest(F.size("m") - 4, F.lit(0)).cast("long").alias("extra"))


@query(f"WITH {P.SQL_RECENT} SELECT cluster_id, image_url AS hero FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY published_at DESC, id DESC) AS rn FROM recent WHERE image_url IS NOT NULL) WHERE rn = 1")
def win_hero_image(spark, sf):
    return P.recent(spark, sf).filter("image_url is not null").groupBy("cluster_id").agg(F.max_by("image_url", F.struct("published_at", "id")).alias("hero"))


@query(f"""WITH {P.SQL_RECENT} SELECT cluster_id, array_to_string(list_sort(list_distinct(list(image_url) || ['https://img.example/0'])), ',') AS candidates FROM recent GROUP BY 1""")
def set_union_candidates(spark, sf):
    every = F.array_distinct(F.array_compact(F.concat(F.collect_list("image_url"), F.array(F.lit("https://img.example/0")))))
    return P.recent(spark, sf).groupBy("cluster_id").agg(F.array_join(F.array_sort(every), ",").alias("candidates"))


# ---- operations -----------------------------------------------------------------------------------------------------------

_SQL_METRICS = f"""WITH {P.SQL_CLUSTERS}, {P.SQL_SOURCES}, a AS (SELECT count(*) AS total, count(*) FILTER (published_at >= {NOW} - INTERVAL 24 HOUR) AS last24h, count(*) FILTER (published_at >= {NOW} - INTERVAL 1 HOUR) AS last_hour,
  count(*) FILTER (category IN ('politika', 'son_dakika') AND image_url IS NULL) AS politics_null_image, count(*) FILTER (category IN ('politika', 'son_dakika')) AS politics_total, count(image_url) AS with_image FROM recent),
c AS (SELECT count(*) AS clusters, count(*) FILTER (article_count >= 2) AS multi, count(*) FILTER (article_count >= 3) AS eligible, count(*) FILTER (article_count >= 3 AND title_tr_neutral IS NOT NULL) AS neutralized,
  min(first_published) FILTER (article_count >= 3 AND title_tr_neutral IS NULL) AS oldest FROM clusters), s AS (SELECT count(*) AS sources, count(*) FILTER (active) AS active FROM sources)
SELECT total, last24h, last_hour, politics_null_image, politics_total, with_image, clusters, multi, eligible, neutralized, sources, active,
CASE WHEN politics_total > 0 THEN floor(politics_null_image * 100.0 / politics_total + 0.5) / 100 ELSE 0 END AS missing_ratio, CASE WHEN clusters > 0 THEN floor(total * 100.0 / clusters + 0.5) / 100 ELSE 0 END AS avg_articles,
CASE WHEN multi > 0 THEN floor((total - (clusters - multi)) * 100.0 / multi + 0.5) / 100 ELSE 0 END AS avg_multi, CASE WHEN eligible > 0 THEN floor(neutralized * 100.0 / eligible + 0.5) / 100 ELSE 1 END AS neutral_ratio,
CAST(greatest(0, floor((epoch_us({NOW}) - epoch_us(oldest)) / 1e6)) AS BIGINT) AS oldest_age FROM a, c, s"""


@query(_SQL_METRICS)
def agg_metrics(spark, sf):
    a = P.recent(spark, sf)
    since = lambda h: F.count_if(F.col("published_at") >= P.as_of() - F.expr(f"interval {h} hours"))
    pol = in_politics(F.col("category"))
    art = a.agg(F.count("*").alias("total"), since(24).alias("last24h"), since(1).alias("last_hour"), F.count_if(pol & F.col("image_url").isNull()).alias("politics_null_image"), F.count_if(pol).alias("politics_total"), F.count("image_url").alias("with_image"))
    big = F.col("article_count") >= 3
    clu = P.clusters(spark, sf).agg(F.count("*").alias("clusters"), F.count_if(F.col("article_count") >= 2).alias("multi"), F.count_if(big).alias("eligible"), F.count_if(big & F.col("title_tr_neutral").isNotNull()).alias("neutralized"), F.min(F.when(big & F.col("title_tr_neutral").isNull(), F.col("first_published"))).alias("oldest"))
    src = P.sources(spark).agg(F.count("*").alias("sources"), F.count_if("active").alias("active"))
    ratio = lambda x, y, empty: F.when(F.col(y) > 0, F.floor(x * 100.0 / F.col(y) + 0.5) / 100).otherwise(float(empty))
    one = art.join(F.broadcast(clu)).join(F.broadcast(src))  # single rows
    return one.select(
        "total", "last24h", "last_hour", "politics_null_image", "politics_total", "with_image", "clusters", "multi", "eligible", "neutralized", "sources", "active",
        ratio(F.col("politics_null_image"), "politics_total", 0).alias("missing_ratio"), ratio(F.col("total"), "clusters", 0).alias("avg_articles"), ratio(F.col("total") - (F.col("clusters") - F.col("multi")), "multi", 0).alias("avg_multi"),
        ratio(F.col("neutralized"), "eligible", 1).alias("neutral_ratio"), F.greatest(F.lit(0), F.floor(scalar.seconds_between(P.as_of(), F.col("oldest")))).alias("oldest_age"),
    )


@query(f"WITH {P.SQL_SOURCES} SELECT id, name, bias, (SELECT count(*) FROM lineitem) AS articles, (SELECT count(*) FROM orders) AS clusters, count(*) OVER () AS sources, count(*) FILTER (active) OVER () AS active_sources FROM sources")
def agg_admin_counts(spark, sf):
    n = P.table(spark, sf, "lineitem").agg(F.count("*").alias("articles")).join(F.broadcast(P.table(spark, sf, "orders").agg(F.count("*").alias("clusters"))))
    s = P.sources(spark)
    counts = s.agg(F.count("*").alias("sources"), F.count_if("active").alias("active_sources"))
    return s.select("id", "name", "bias").join(F.broadcast(n.join(F.broadcast(counts)))).orderBy("bias", "id")  # single rows


@query("""WITH h AS (SELECT CASE WHEN l_orderkey % 11 = 0 THEN NULL WHEN l_orderkey % 2 = 0 THEN sha1(CAST(l_orderkey AS VARCHAR)) WHEN l_orderkey % 13 = 0 THEN 'x' ELSE sha256(CAST(l_orderkey AS VARCHAR)) END AS h FROM lineitem)
SELECT count(*) AS total, count(*) FILTER (length(h) = 40) AS sha1, count(*) FILTER (length(h) = 64) AS sha256, count(*) FILTER (h IS NULL) AS missing, count(*) FILTER (length(h) NOT IN (40, 64)) AS other FROM h""")
def agg_hash_regimes(spark, sf):
    k = F.col("l_orderkey")
    text = k.cast("string").cast("binary")
    h = P.table(spark, sf, "lineitem").select(F.when(k % 11 == 0, None).when(k % 2 == 0, F.sha1(text)).when(k % 13 == 0, "x").otherwise(F.sha2(text, 256)).alias("h"))
    n = F.length("h")
    return h.agg(F.count("*").alias("total"), F.count_if(n == 40).alias("sha1"), F.count_if(n == 64).alias("sha256"), F.count_if(F.col("h").isNull()).alias("missing"), F.count_if(~n.isin(40, 64)).alias("other"))


SQL_QUEUE = f"WITH {P.SQL_ARRIVALS}, q AS (SELECT *, CASE WHEN event_type IN ('view', 'click') THEN 'cluster_work' ELSE 'image_backfill' END AS queue_name FROM arrivals)"


def _queue(spark, sf):
    return P.arrivals(spark, sf).withColumn("queue_name", F.when(F.col("event_type").isin("view", "click"), "cluster_work").otherwise("image_backfill"))


@query(SQL_QUEUE + f" SELECT queue_name, count(*) AS queue_length, CAST(floor((epoch_us({NOW}) - epoch_us(max(published_at))) / 1e6) AS BIGINT) AS newest_age, CAST(floor((epoch_us({NOW}) - epoch_us(min(published_at))) / 1e6) AS BIGINT) AS oldest_age FROM q GROUP BY 1")
def agg_queue_metrics(spark, sf):
    from prismfeed.operators.operations import queue_metrics

    return queue_metrics(_queue(spark, sf), P.as_of())


@query(SQL_QUEUE + f""", m AS (SELECT queue_name, count(*) AS n, floor((epoch_us({NOW}) - epoch_us(min(published_at))) / 1e6) AS age FROM q GROUP BY 1), t AS (SELECT bool_and(n <= CASE queue_name WHEN 'cluster_work' THEN 500 ELSE 100 END AND age <= 1800) AS queues_ok FROM m),
i AS (SELECT floor((epoch_us({NOW}) - epoch_us(max(published_at))) / 1e6) < 600 AS ingestion_ok FROM arrivals), c AS (SELECT floor((epoch_us({NOW}) - epoch_us(max(o_orderdate))) / 1e6) < 900 AS clustering_ok FROM orders)
SELECT ingestion_ok, clustering_ok, queues_ok, CASE WHEN ingestion_ok AND clustering_ok AND queues_ok THEN 'healthy' ELSE 'degraded' END AS verdict FROM t, i, c""")
def agg_health_rollup(spark, sf):
    from prismfeed.operators.operations import health

    return health(P.arrivals(spark, sf), P.table(spark, sf, "orders").select(F.col("o_orderdate").cast("timestamp").alias("updated_at")), _queue(spark, sf), P.as_of())


@query(f"WITH {P.SQL_ARRIVALS} SELECT count(DISTINCT source_id) AS sources, count(*) AS fetched, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type <> 'error') AS inserted FROM arrivals")
def agg_cycle_stats(spark, sf):
    a = P.arrivals(spark, sf)
    bad = F.col("event_type") == "error"
    return a.agg(F.countDistinct("source_id").alias("sources"), F.count("*").alias("fetched"), F.count_if(bad).alias("failed"), F.count_if(~bad).alias("inserted"))


@query(f"WITH {P.SQL_ARRIVALS} SELECT event_type AS outcome, count(*) AS n FROM arrivals GROUP BY 1")
def agg_drain_summary(spark, sf):
    return P.arrivals(spark, sf).groupBy(F.col("event_type").alias("outcome")).agg(F.count("*").alias("n"))


@query(f"WITH {P.SQL_MEMBERS} SELECT cluster_id, strftime(least(min(published_at), TIMESTAMP '1999-01-01'), '%Y-%m-%d %H:%M:%S') AS first_published FROM members GROUP BY 1")
def agg_min_first_published(spark, sf):
    return P.members(spark, sf).groupBy("cluster_id").agg(P.stamp(F.least(F.min("published_at"), F.to_timestamp(F.lit("1999-01-01")))).alias("first_published"))
