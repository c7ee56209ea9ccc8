"""Feeds: landed bytes, charset, XML items, normalised articles.

Feeds land as files (source_id, content_type, body); a fetcher outside the engine
writes them. Decoding runs on Arrow batches, all else in built-in expressions.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismfeed.functions import clean, text

# Charset names and the codecs that read them.
CHARSETS = {
    "utf-8": "utf-8", "utf8": "utf-8", "us-ascii": "utf-8", "ascii": "utf-8", "iso-8859-9": "windows-1254", "iso8859-9": "windows-1254", "windows-1254": "windows-1254", "cp1254": "windows-1254",
    "iso-8859-1": "windows-1252", "iso8859-1": "windows-1252", "latin1": "windows-1252", "windows-1252": "windows-1252", "cp1252": "windows-1252",
}
PROLOG_BYTES = 256
ITEM = "title string, link string, description string, `content:encoded` string, pubDate string, `dc:date` string, enclosure array<struct<_url:string,_type:string>>, `media:content` array<struct<_url:string>>, `media:thumbnail` array<struct<_url:string>>, `media:group` struct<`media:content`:array<struct<_url:string>>>, image string"
_ITEMS = f"array<struct<{ITEM.replace(' string', ':string').replace(' array', ':array').replace(' struct', ':struct')}>>"
RSS = f"channel struct<item: {_ITEMS}>"
ATOM = "entry array<struct<title:string,link:array<struct<_href:string,_rel:string>>,summary:string,content:string,published:string,updated:string>>"


def header_charset(content_type: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(content_type, '(?i)charset\\s*=\\s*"?([^";\\s]+)"?', 1)), F.lit(""))


def prolog_charset(body: Column) -> Column:
    head = F.decode(F.substring(body, 1, PROLOG_BYTES), "ISO-8859-1")
    return F.nullif(F.lower(F.regexp_extract(head, "(?i)<\\?xml[^?]*encoding\\s*=\\s*[\"']([^\"']+)[\"']", 1)), F.lit(""))


def known_charset(name: Column) -> Column:
    return F.coalesce(*[F.when(name == k, F.lit(v)) for k, v in CHARSETS.items()])


@F.pandas_udf(T.StringType())
def decoded(body: pd.Series, charset: pd.Series) -> pd.Series:
    """Bytes as text, malformed ones replaced, a leading byte order mark dropped."""
    out = [None if b is None else bytes(b).decode(c.replace("windows-", "cp") if c else "utf-8", "replace").removeprefix("\ufeff") for b, c in zip(body, charset, strict=True)]
    return pd.Series(out, dtype=object)


def decode_bodies(feeds: DataFrame) -> DataFrame:
    """Feeds with charset (header, then prolog, then UTF-8; unknown names are passed over) and xml."""
    charset = F.coalesce(known_charset(header_charset(F.col("content_type"))), known_charset(prolog_charset(F.col("body"))), F.lit("utf-8"))
    return feeds.withColumn("charset", charset).withColumn("xml", decoded("body", "charset"))


def landed(spark: SparkSession, path: str) -> DataFrame:
    """Landed files as feeds; the file name is the source's id."""
    f = spark.read.format("binaryFile").load(path)
    return f.select(F.regexp_extract("path", r"([^/]+)\.[a-z]+$", 1).alias("source_id"), F.lit(None).cast("string").alias("content_type"), F.col("content").alias("body"))


def changed_only(feeds: DataFrame, seen: DataFrame) -> DataFrame:
    """Feeds whose body was not the source's last one, for sources that answer no conditional request; seen: (source_id, digest)."""
    return feeds.withColumn("digest", F.sha2("body", 256)).join(seen.select("source_id", "digest"), ["source_id", "digest"], "left_anti")


def conditional_headers(sources: DataFrame, cache: DataFrame) -> DataFrame:
    """(source_id, if_none_match, if_modified_since) of each source's next request; cache: (source_id, etag, last_modified)."""
    return sources.join(cache, "source_id", "left").select("source_id", F.col("etag").alias("if_none_match"), F.col("last_modified").alias("if_modified_since"))


def fetch_results(responses: DataFrame) -> DataFrame:
    """(source_id, status, not_modified, error, content_type, body) of logged responses (status 0 and error: no answer came).

    Only an answer of the 200s has a body to read; 304 tells that nothing changed.
    """
    good, same = F.col("status").between(200, 299), F.col("status") == 304
    error = F.when(F.col("status") == 0, F.coalesce("error", F.lit("no answer"))).when(~good & ~same, F.concat(F.lit("Status code "), F.col("status").cast("string")))
    return responses.select("source_id", "status", same.alias("not_modified"), error.alias("error"), "content_type", F.when(good, F.col("body")).alias("body"))


def refreshed_cache(cache: DataFrame, responses: DataFrame) -> DataFrame:
    """The cache (source_id, etag, last_modified) after these responses: those of the 200s that name either replace their source's row."""
    new = responses.filter(F.col("status").between(200, 299) & F.coalesce("etag", "last_modified").isNotNull()).select("source_id", "etag", "last_modified")
    return cache.select("source_id", "etag", "last_modified").join(new.select("source_id"), "source_id", "left_anti").unionByName(new)


def _rss_items(xml: Column) -> Column:
    x = F.from_xml(xml, F.lit(f"struct<{RSS.replace('channel struct', 'channel:struct')}>"), {"rowTag": "rss", "attributePrefix": "_", "valueTag": "_v"})
    return x["channel"]["item"]


def _rdf_items(xml: Column, tag: str) -> Column:
    return F.from_xml(xml, F.lit(f"struct<item:{_ITEMS}>"), {"rowTag": tag, "attributePrefix": "_", "valueTag": "_v"})["item"]


def parse_items(feeds: DataFrame) -> DataFrame:
    """(source_id, title, link, content, summary, date, enclosure, media, thumbnail, group, image): RSS items, else Atom entries, else items of RDF (RSS 1.0)."""
    rss = _rss_items(F.col("xml"))
    atom = F.from_xml(F.col("xml"), F.lit(f"struct<{ATOM.replace('entry array', 'entry:array')}>"), {"rowTag": "feed", "attributePrefix": "_", "valueTag": "_v"})["entry"]
    rdf = F.coalesce(*[F.when(F.regexp_like("xml", F.lit(f"<{tag}[\\s>]")), _rdf_items(F.col("xml"), tag)) for tag in ("rdf:RDF", "RDF")])
    base = feeds.select("source_id", F.coalesce(rss, F.when(atom.isNull(), rdf)).alias("rss"), atom.alias("atom"))
    items = base.filter("rss is not null").select("source_id", F.explode("rss").alias("i"))
    images = F.filter(F.col("i.enclosure"), lambda e: e["_type"].startswith("image/"))
    enclosure = F.coalesce(F.get(images, F.lit(0)), F.get(F.col("i.enclosure"), F.lit(0)))
    first = lambda c: F.get(F.col(c), F.lit(0))["_url"]
    from_rss = items.select(
        "source_id", F.col("i.title").alias("title"), F.col("i.link").alias("link"), F.coalesce(F.col("i.`content:encoded`"), F.col("i.description")).alias("content"), F.col("i.description").alias("summary"), F.coalesce("i.pubDate", "i.`dc:date`").alias("date"),
        enclosure["_url"].alias("enclosure"), enclosure["_type"].alias("enclosure_type"), first("i.`media:content`").alias("media"), first("i.`media:thumbnail`").alias("thumbnail"), first("i.`media:group`.`media:content`").alias("group"), F.col("i.image").alias("image"),
    )
    entries = base.filter("rss is null and atom is not null").select("source_id", F.explode("atom").alias("i"))
    alternate = F.filter(F.col("i.link"), lambda k: k["_rel"].isNull() | (k["_rel"] == "alternate"))
    link = F.coalesce(F.get(alternate, F.lit(0)), F.get(F.col("i.link"), F.lit(0)))["_href"]
    none = F.lit(None).cast("string")
    from_atom = entries.select(
        "source_id", F.col("i.title").alias("title"), link.alias("link"), F.col("i.content").alias("content"), F.coalesce("i.summary", "i.content").alias("summary"), F.coalesce("i.published", "i.updated").alias("date"),
        *[none.alias(c) for c in ("enclosure", "enclosure_type", "media", "thumbnail", "group", "image")],
    )
    return from_rss.unionByName(from_atom)


def normalise(items: DataFrame, sources: DataFrame, now: Column) -> DataFrame:
    """Articles of items with a title and a link; the hash falls back to the title alone, then to the URL."""
    s = sources.select(F.col("id").alias("source_id"), "slug", F.col("url").alias("base"))
    rows = items.join(s, "source_id").filter((clean.trim_blanks(F.col("title")) != "") & (clean.trim_blanks(F.col("link")) != ""))
    title = clean.clean_title(F.col("title"))
    url = clean.absolute_url(clean.trim_blanks(F.col("link")), F.col("base"))
    rows = rows.select("*", title.alias("clean_title"), clean.clean_description(F.col("summary")).alias("description"), url.alias("url"))
    norm = text.normalize_turkish(text.joined_text(F.col("clean_title"), F.col("description")))
    hash_ = F.coalesce(text.strict_fingerprint(norm), F.sha1(F.col("url").cast("binary")))
    image = clean.feed_image(*[F.col(c) for c in ("enclosure", "enclosure_type", "media", "thumbnail", "group", "image", "content")])
    category = clean.classify_category(F.col("clean_title"), F.col("description"), clean.canonical_url(F.col("url"), F.col("slug")), F.col("slug"))
    return rows.select("source_id", F.col("clean_title").alias("title"), "description", "url", image.alias("image_url"), clean.parse_date(F.col("date"), now).alias("published_at"), hash_.alias("content_hash"), category.alias("category"))
