"""Serving analytics: feeds, blindspots, cross-spectrum surprises, trends and timelines.

Members are rows (cluster_id, id, source_id, bias, category, content_hash,
published_at, image_url, title); clusters are rows (id, title_tr,
title_tr_neutral, summary_tr, article_count, first_published, updated_at). `now`
is always given, and every ranking has a total order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismfeed.schema import ZONES, in_politics, opposite_of, zone_of

# Fixed values of the feed: limits, thresholds and weights.
CANDIDATES, SHOWN, MAJORITY, WIRE, CAP, DOMINANT = 200, 30, 0.6, 0.5, 0.1, 0.6
W_COUNT, W_ZONES, W_DECAY, W_DOMINANCE, W_VELOCITY, HALF_HOURS = 1.0, 0.5, 0.5, 0.2, 1.0, 6
BREAKING_HOURS, BREAKING = 2, 6
BLIND_CANDIDATES, BLIND_MEMBERS, BLIND_SHARE, BLIND_COUNT, DUNYA = 80, 5, 0.8, 3, 0.5


def latest(clusters: DataFrame, n: int = CANDIDATES, least: int = 2) -> DataFrame:
    """The n clusters updated last among those of `least` articles or more; a bounded table, so joins may broadcast it."""
    return clusters.filter(F.col("article_count") >= least).orderBy(F.desc("updated_at"), F.desc("id")).limit(n)


def first_per_source(members: DataFrame) -> DataFrame:
    """The earliest article of each source in each cluster."""
    w = Window.partitionBy("cluster_id", "source_id").orderBy(F.asc_nulls_last("published_at"), "id")
    return members.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def pseudo_hash(content_hash: Column, id: Column) -> Column:
    """Missing hashes count as distinct ones."""
    return F.coalesce(content_hash, F.concat(F.lit("__null__:"), id.cast("string")))


def politics_majority(members: DataFrame, share: float = MAJORITY) -> DataFrame:
    """Clusters whose members are politics by the share or more, with their number."""
    return members.groupBy("cluster_id").agg(F.count("*").alias("members"), F.avg(in_politics(F.col("category")).cast("int")).alias("share")).filter(F.col("share") >= share)


def wire(deduped: DataFrame) -> DataFrame:
    """(cluster_id, n, unique_hashes, is_wire): copies of one wire story."""
    n, unique = F.count("*"), F.countDistinct(pseudo_hash(F.col("content_hash"), F.col("id")))
    agg = deduped.groupBy("cluster_id").agg(n.alias("n"), unique.alias("u"))
    small = F.col("n") < 3
    return agg.select("cluster_id", "n", F.when(small, F.col("n")).otherwise(F.col("u")).alias("unique_hashes"), (~small & (F.col("u") / F.col("n") <= WIRE)).alias("is_wire"))


def fairness(members: DataFrame) -> DataFrame:
    """(cluster_id, effective, capped): each source counts for a tenth of the cluster at most; members before source dedupe."""
    by = members.groupBy("cluster_id", "source_id").agg(F.count("*").alias("c"), F.min(F.struct("published_at", "id")).alias("seen"))
    total = by.withColumn("total", F.sum("c").over(Window.partitionBy("cluster_id")))
    cap = F.greatest(F.lit(1), F.ceil(F.col("total") * CAP))
    entries = F.array_sort(F.collect_list(F.when(F.col("c") > F.col("cap"), F.struct("seen", "source_id"))))
    return total.withColumn("cap", cap).groupBy("cluster_id").agg(F.sum(F.least("c", "cap")).alias("effective"), F.transform(entries, lambda x: x["source_id"]).alias("capped"))


def velocity(deduped: DataFrame, now: Column) -> DataFrame:
    """(cluster_id, velocity): the share of the last day's articles that are two hours old at most."""
    age = F.unix_micros(now) - F.unix_micros("published_at")
    recent, day = F.count_if(age <= 2 * 3_600_000_000), F.count_if(age <= 24 * 3_600_000_000)
    return deduped.groupBy("cluster_id").agg(F.when(day > 0, recent / day).otherwise(0.0).alias("velocity"))


def feed_bundles(clusters: DataFrame, members: DataFrame, now: Column, n: int = CANDIDATES) -> DataFrame:
    """Candidates with a politics majority, folded and scored; a row for each cluster."""
    top = latest(clusters, n)
    mine = members.join(F.broadcast(top.select(F.col("id").alias("cluster_id"))), "cluster_id", "left_semi")  # n rows at most
    deduped = first_per_source(mine)
    zones = deduped.groupBy("cluster_id").agg(F.countDistinct(zone_of(F.col("bias"))).alias("zones"), F.count("*").alias("article_count"))
    largest = deduped.groupBy("cluster_id", "source_id").count().groupBy("cluster_id").agg((F.max("count") / F.sum("count") > DOMINANT).cast("int").alias("dominance"))
    shown = (top.drop("article_count").withColumnRenamed("id", "cluster_id").join(politics_majority(mine).select("cluster_id"), "cluster_id").join(wire(deduped), "cluster_id")
             .join(fairness(mine), "cluster_id").join(velocity(deduped, now), "cluster_id").join(zones, "cluster_id").join(largest, "cluster_id"))
    effective = F.least(F.when(F.col("is_wire"), F.col("unique_hashes")).otherwise(F.col("n")), F.col("effective"))
    age_hours = (F.unix_micros(now) - F.unix_micros("first_published")) / 3.6e9
    score = W_COUNT * F.log2(effective + 1.0) + W_ZONES * F.log2(F.col("zones") + 1.0) - W_DECAY * (age_hours / HALF_HOURS) - W_DOMINANCE * F.col("dominance") + W_VELOCITY * F.col("velocity")
    return shown.withColumn("title", display_title(F.col("title_tr_neutral"), F.col("title_tr"))).withColumn("score", score)


def display_title(neutral: Column, title: Column) -> Column:
    return F.when(F.length(F.trim(neutral)) > 0, neutral).otherwise(title)


def ranked(bundles: DataFrame, n: int = SHOWN) -> DataFrame:
    return bundles.orderBy(F.desc(F.round("score", 9)), F.desc("updated_at"), F.desc("cluster_id")).limit(n)


def breaking(bundles: DataFrame, now: Column) -> DataFrame:
    fresh = F.unix_micros(now) - F.unix_micros("first_published") < BREAKING_HOURS * 3_600_000_000
    return bundles.filter(fresh).orderBy(F.desc("first_published"), F.desc("cluster_id")).limit(BREAKING)


def zone_counts(members: DataFrame) -> DataFrame:
    """(cluster_id, total, iktidar, bagimsiz, muhalefet); rows of unknown bias count for the total alone."""
    z = zone_of(F.col("bias"))
    return members.groupBy("cluster_id").agg(F.count("*").alias("total"), *[F.count_if(z == k).alias(k) for k in ZONES])


def dominant_zone(counts: DataFrame, order: tuple[str, ...], threshold: float = 0.0) -> DataFrame:
    """The zone of the largest share, the first in `order` among equals, null unless positive and at the threshold."""
    best = F.greatest(*[F.col(z) for z in order])
    zone = F.coalesce(*[F.when(F.col(z) == best, F.lit(z)) for z in order])
    share = best / F.col("total")
    ok = (best > 0) & (share >= threshold)
    return counts.withColumn("dominant_zone", F.when(ok, zone)).withColumn("dominant_pct", F.when(ok, share).otherwise(0.0))


def blindspots(clusters: DataFrame, members: DataFrame, now: Column, seo: Column) -> DataFrame:
    """Clusters that one zone covers almost alone: filtered, the first 30 by update, then by share. seo: titles to drop."""
    old = clusters.filter((F.col("article_count") >= BLIND_COUNT) & (F.unix_micros("first_published") < F.unix_micros(now) - 24 * 3_600_000_000))
    top = old.orderBy(F.desc("updated_at"), F.desc("id")).limit(BLIND_CANDIDATES)
    mine = first_per_source(members.join(F.broadcast(top.select(F.col("id").alias("cluster_id"))), "cluster_id", "left_semi"))
    facts = mine.groupBy("cluster_id").agg(
        F.count("*").alias("n"), F.countDistinct(pseudo_hash(F.col("content_hash"), F.col("id"))).alias("u"),
        F.avg((F.col("category") == "dunya").cast("int")).alias("dunya"), F.avg(in_politics(F.col("category")).cast("int")).alias("politics"),
    )
    zones = dominant_zone(zone_counts(mine), ("iktidar", "muhalefet", "bagimsiz"), BLIND_SHARE).filter("dominant_zone is not null")
    good = facts.filter((F.col("n") >= BLIND_MEMBERS) & (F.col("u") / F.col("n") >= WIRE) & (F.col("dunya") <= DUNYA) & (F.col("politics") >= MAJORITY))
    kept = top.filter(~seo).withColumnRenamed("id", "cluster_id").join(good, "cluster_id").join(zones.drop("total"), "cluster_id")
    first = kept.orderBy(F.desc("updated_at"), F.desc("cluster_id")).limit(SHOWN)
    return first.orderBy(F.desc("dominant_pct"), F.desc("updated_at"), F.desc("cluster_id"))


def cross_spectrum(members: DataFrame, threshold: float = 0.65) -> DataFrame:
    """(cluster_id, dominant_zone, dominant_pct, surprises, blindspot_candidate); clusters without a verdict have nulls."""
    z = dominant_zone(zone_counts(members), ZONES, threshold)
    count = lambda zone: F.coalesce(*[F.when(zone == k, F.col(k)) for k in ZONES], F.lit(0))
    opposite = opposite_of(F.col("dominant_zone"))
    fires = (F.col("total") >= 5) & F.col("dominant_zone").isNotNull() & (count(F.col("dominant_zone")) - count(opposite) >= 3)
    out = z.select(
        "cluster_id", F.when(fires, F.col("dominant_zone")).alias("dominant_zone"), F.when(fires, F.col("dominant_pct")).otherwise(0.0).alias("dominant_pct"),
        F.when(fires, count(opposite)).otherwise(0).alias("surprises"), F.coalesce(fires & (F.col("dominant_pct") >= 0.85), F.lit(False)).alias("blindspot_candidate"),
    )
    return out


def trends_daily(articles: DataFrame) -> DataFrame:
    """(day, zone, count) in UTC; unknown bias has a null zone."""
    return articles.groupBy(F.to_date(F.date_trunc("day", "published_at")).alias("day"), zone_of(F.col("bias")).alias("zone")).agg(F.count("*").alias("count"))


def gap_filled(daily: DataFrame, today: Column, days: int = 30) -> DataFrame:
    """A row for each of the days up to today, with the count of each zone and the total; rows outside are dropped."""
    calendar = daily.sparkSession.range(1).select(F.explode(F.sequence(F.date_sub(today, days - 1), today, F.expr("interval 1 day"))).alias("day"))
    sums = daily.groupBy("day").agg(*[F.coalesce(F.sum(F.when(F.col("zone") == z, F.col("count"))), F.lit(0)).alias(z) for z in ZONES], F.sum("count").alias("total"))
    return calendar.join(sums, "day", "left").na.fill(0)


def page_bucket(first_published: Column, now: Column) -> Column:
    age = F.unix_micros(now) - F.unix_micros(first_published)
    return F.when(age < 86_400_000_000, "today").when(age < 7 * 86_400_000_000, "thisWeek").otherwise("older")


def rss_item(cluster_id: Column, title: Column, count: Column, summary: Column, published: Column, base: str, escape) -> Column:
    link = F.concat(F.lit(f"{base}/cluster/"), cluster_id.cast("string"))
    text = F.concat(count.cast("string"), F.lit(" kaynaktan haberler. "), F.left(F.coalesce(summary, F.lit("")), F.lit(240)))
    stamp = F.date_format(published, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    return F.concat(
        F.lit("<item><title>"), escape(F.coalesce(title, F.lit("Başlıksız"))), F.lit("</title><link>"), link, F.lit('</link><guid isPermaLink="true">'), link,
        F.lit("</guid><pubDate>"), stamp, F.lit("</pubDate><description>"), escape(text), F.lit("</description></item>"),
    )


def rss_document(items: DataFrame, order: list, title: str, about: str, base: str, now: Column) -> DataFrame:
    """One row `document`: an RSS document of the items (item, ...) in this order, those of a feed's page."""
    placed = items.select("item", F.row_number().over(Window.orderBy(*order)).alias("n"))  # at most SHOWN rows
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "item"))), lambda x: x["item"]), "")
    head = f'<?xml version="1.0" encoding="UTF-8"?><rss version="2.0" xmlns:atom="http://www.w3.org/2005/Atom"><channel><title>{title}</title><link>{base}/</link><atom:link href="{base}/rss.xml" rel="self" type="application/rss+xml"/><description>{about}</description><language>tr-TR</language><lastBuildDate>'
    stamp = F.date_format(now, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    return placed.agg(F.concat(F.lit(head), stamp, F.lit("</lastBuildDate>"), body, F.lit("</channel></rss>")).alias("document"))
