"""News-shaped views of the benchmark tables, in DataFrames and in SQL.

An order is a cluster, its line items are the articles, thirty sources stand
behind supplier keys, events are arrivals, documents are article texts and pages
are fetched URLs. `recent` members lie within hours of AS_OF, `members` within
years. Timestamps are cast once, in the session's time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismfeed.schema import BIAS_KEYS, BIAS_ZONE
from prismfeed.staging import spread

AS_OF = "2024-01-31 00:00:00"
N_SOURCES = 30


def as_of() -> Column:
    return F.to_timestamp(F.lit(AS_OF))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bias_of(n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, BIAS_KEYS)), (n % len(BIAS_KEYS) + 1).cast("int"))


def stamp(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


#: What tells line items apart; no two of the given tables agree in all of it.
_LINE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def _line_id() -> Column:
    """60 bits of a digest of the line item's key; numbers with digits behind the point as hundredths."""
    parts = [F.round(F.col(c) * 100).cast("long") if c in ("l_quantity", "l_extendedprice") else F.col(c) for c in _LINE_KEY]
    return F.conv(F.left(F.md5(F.concat_ws("/", *[x.cast("string") for x in parts])), F.lit(15)), 16, 10).cast("long")


def _members(spark: SparkSession, sf_dir: str, published: Column) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    return line.select(
        _line_id().alias("id"), F.col("l_orderkey").alias("cluster_id"), (F.col("l_suppkey") % N_SOURCES).alias("source_id"), bias_of(F.col("l_suppkey")).alias("bias"),
        F.when(F.col("l_returnflag") == "R", "dunya").when(F.col("l_returnflag") == "A", "son_dakika").otherwise("politika").alias("category"),
        F.when(F.col("l_quantity") >= 5, (F.col("l_partkey") % 4).cast("string")).alias("content_hash"), published.alias("published_at"),
        F.when(F.col("l_partkey") % 3 != 0, F.concat(F.lit("https://img.example/"), F.col("l_partkey").cast("string"))).alias("image_url"),
    )


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _members(spark, sf_dir, F.col("l_shipdate").cast("timestamp"))


def recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    minutes = (F.col("l_orderkey") * 37) % 1700 + F.col("l_linenumber") * 13
    return _members(spark, sf_dir, F.timestamp_micros(F.unix_micros(as_of()) - minutes * 60_000_000))


def clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the number and earliest time of their recent members."""
    facts = recent(spark, sf_dir).groupBy("cluster_id").agg(F.count("*").alias("article_count"), F.min("published_at").alias("first_published"))
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("Haber "), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 17 == 0, " kimdir").otherwise("")).alias("title_tr"),
        F.when(F.col("o_orderkey") % 3 == 0, F.lit("  ")).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("Yalın "), F.col("o_orderkey").cast("string"))).alias("title_tr_neutral"),
        F.concat(F.lit("Özet & <"), F.col("o_orderpriority"), F.lit(">")).alias("summary_tr"), F.col("o_orderdate").cast("timestamp").alias("updated_at"), F.col("o_orderstatus").alias("status"),
    )
    return o.join(facts, o.id == facts.cluster_id).drop("cluster_id")


def sources(spark: SparkSession) -> DataFrame:
    n = F.col("id")
    return spark.range(N_SOURCES).select(
        "id", F.concat(F.lit("src"), n.cast("string")).alias("slug"), F.concat(F.lit("Kaynak "), n.cast("string")).alias("name"), bias_of(n).alias("bias"), (n % 7 != 0).alias("active"),
        F.concat(F.when(n % 2 == 0, "https://www.").otherwise("http://"), F.lit("site"), n.cast("string"), F.lit(".example/rss")).alias("url"),
        F.when(n % 5 == 0, F.concat(F.lit("https://logo.example/"), n.cast("string"))).alias("logo_url"),
    )


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("published_at"), (F.col("user_id") % N_SOURCES).alias("source_id"), bias_of(F.col("user_id")).alias("bias"), "event_type", "value", "props", "user_id")


#: Fixed inputs of the text operators: Turkish titles and descriptions.
STORIES = [
    ("MHP İstanbul'da il teşkilatını feshetti", "MHP Genel Başkanı Bahçeli İstanbul il teşkilatının feshedildiğini açıkladı"),
    ("MHP İstanbul il teşkilatını fesh etti", "Bahçeli açıklamasında İstanbul'daki il teşkilatının feshedildiğini söyledi"),
    ("Cumhurbaşkanı Erdoğan Almanya ziyaretinde konuştu", "Erdoğan Berlin'deki temaslarında ekonomi ve dış politika gündemine değindi"),
    ("TCMB faiz kararını 2024 yılında açıkladı", "Merkez Bankası yüzde 47 seviyesindeki politika faizini sabit tuttu"),
    ("Galatasaray Fenerbahçe derbisinde 3-1 galip geldi", "Süper Lig'in dev derbisi Galatasaray'ın üstünlüğüyle sonuçlandı"),
    ("Galatasaray Fenerbahçe maçında 3 gol attı", "Derbi mücadelesinde sarı-kırmızılılar üç gollü galibiyetle ayrıldı"),
    ("Diyanet Cuma hutbesinde Ramazan açıklaması yaptı", "Diyanet İşleri Başkanlığı camide okunan hutbede Ramazan ayına değindi"),
    ("Hrant Dink anması İstanbul'da yapıldı", "Ermeni gazeteci Hrant Dink ölümünün yıl dönümünde Agos önünde anıldı"),
    ("Turkey's parliament passed the new economy bill", "Turkish president Erdogan praised the central bank's policy stance"),
    ("AYM 2020/2003 başvurusunu reddetti", "Anayasa Mahkemesi bireysel başvurunun esastan reddedildiğini duyurdu"),
]
STORY_HOURS = (0.0, 0.5, 2.0, 3.0, 5.0, 5.5, 7.0, 10.0, 12.0, 18.0)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, title, description, source_slug, hours): documents cut at their first line, and the fixed stories."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id")
    rest = F.when(F.instr("text", "\n") > 0, F.expr("substring(text, instr(text, '\n') + 1)"))
    docs = d.select(F.col("doc_id").alias("id"), F.split("text", "\n", 2)[0].alias("title"), rest.alias("description"), F.col("source").alias("slug"), (F.col("doc_id") % 97).cast("double").alias("hours"))
    rows = [(-1 - i, t, x, "haberler-com" if i == 1 else f"s{i}", h) for i, ((t, x), h) in enumerate(zip(STORIES, STORY_HOURS, strict=True))]
    return docs.unionByName(spark.createDataFrame(rows, "id long, title string, description string, slug string, hours double"))


# The same views in SQL.
_quoted = lambda s: "'" + s.replace("'", "''") + "'"
SQL_BIAS = "[" + ", ".join(map(_quoted, BIAS_KEYS)) + "]"
SQL_AS_OF = f"TIMESTAMP '{AS_OF}'"


def sql_zone(bias: str) -> str:
    return f"CASE {bias} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in BIAS_ZONE.items()) + " END"


def _sql_members(published: str) -> str:
    key = ", ".join(f"CAST(round({c} * 100) AS BIGINT)" if c in ("l_quantity", "l_extendedprice") else c for c in _LINE_KEY)
    return f"""SELECT CAST('0x' || left(md5(concat_ws('/', {key})), 15) AS BIGINT) AS id, l_orderkey AS cluster_id, l_suppkey % {N_SOURCES} AS source_id, {SQL_BIAS}[1 + l_suppkey % 10] AS bias,
      CASE l_returnflag WHEN 'R' THEN 'dunya' WHEN 'A' THEN 'son_dakika' ELSE 'politika' END AS category, CASE WHEN l_quantity >= 5 THEN CAST(l_partkey % 4 AS VARCHAR) END AS content_hash,
      {published} AS published_at, CASE WHEN l_partkey % 3 <> 0 THEN 'https://img.example/' || l_partkey END AS image_url FROM lineitem"""


SQL_MEMBERS = f"members AS ({_sql_members('l_shipdate')})"
SQL_RECENT = f"recent AS ({_sql_members(f'{SQL_AS_OF} - to_minutes(CAST((l_orderkey * 37) % 1700 + l_linenumber * 13 AS INTEGER))')})"
SQL_CLUSTERS = f"""{SQL_RECENT}, clusters AS (SELECT o_orderkey AS id, 'Haber ' || o_orderkey || CASE WHEN o_orderkey % 17 = 0 THEN ' kimdir' ELSE '' END AS title_tr,
      CASE o_orderkey % 3 WHEN 0 THEN '  ' WHEN 1 THEN 'Yalın ' || o_orderkey END AS title_tr_neutral, 'Özet & <' || o_orderpriority || '>' AS summary_tr, o_orderdate AS updated_at, o_orderstatus AS status,
      article_count, first_published FROM orders JOIN (SELECT cluster_id, count(*) AS article_count, min(published_at) AS first_published FROM recent GROUP BY 1) ON cluster_id = o_orderkey)"""
SQL_SOURCES = f"""sources AS (SELECT id, 'src' || id AS slug, 'Kaynak ' || id AS name, {SQL_BIAS}[1 + id % 10] AS bias, id % 7 <> 0 AS active,
      CASE WHEN id % 2 = 0 THEN 'https://www.' ELSE 'http://' END || 'site' || id || '.example/rss' AS url, CASE WHEN id % 5 = 0 THEN 'https://logo.example/' || id END AS logo_url FROM range({N_SOURCES}) t(id))"""
SQL_ARRIVALS = f"arrivals AS (SELECT event_id AS id, ts AS published_at, user_id % {N_SOURCES} AS source_id, {SQL_BIAS}[1 + user_id % 10] AS bias, event_type, value, props, user_id FROM events)"
SQL_TEXTS = """texts AS (SELECT doc_id AS id, string_split(text, chr(10))[1] AS title, CASE WHEN instr(text, chr(10)) > 0 THEN text[instr(text, chr(10)) + 1:] END AS description, source AS slug, CAST(doc_id % 97 AS DOUBLE) AS hours
      FROM documents UNION ALL VALUES """ + ", ".join(
    f"({-1 - i}, {_quoted(t)}, {_quoted(x)}, '{'haberler-com' if i == 1 else f's{i}'}', CAST({h} AS DOUBLE))" for i, ((t, x), h) in enumerate(zip(STORIES, STORY_HOURS, strict=True))
) + ")"
SQL_FIRST = "deduped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id, source_id ORDER BY published_at ASC NULLS LAST, id) AS rn FROM {src}) WHERE rn = 1)"
SQL_PSEUDO = "coalesce(content_hash, '__null__:' || id)"
