"""Text features, scalar functions, TF-IDF and the ensemble score."""

from __future__ import annotations

from pyspark.sql import functions as F

from prismfeed.functions import clean, scalar, text
from prismfeed.operators import clustering as C
from prismfeed.plans import proxy as P
from prismfeed.plans.registry import query
from prismfeed.plans.stream_queries import replayed
from prismfeed.staging import staged
from prismfeed.streaming import stateful

R = lambda x: F.round(x, 9)
NOW = P.SQL_AS_OF
_q = lambda words: ", ".join("'" + w.replace("'", "''") + "'" for w in words)

# ---- SQL forms ------------------------------------------------------------------------------------------------------------

_FOLDED = f"lower(translate(coalesce({{x}}, ''), '{text.FOLD_FROM}', '{text.FOLD_TO}'))"


def sql_tokens(x: str) -> str:
    words = f"string_split(regexp_replace({_FOLDED.format(x=x)}, '[^a-z0-9]+', ' ', 'g'), ' ')"
    return f"list_filter({words}, lambda t: t <> '' AND t NOT IN ({_q(w for w in text.STOP_WORDS if w.isascii())}) AND (length(t) > 1 OR regexp_matches(t, '^[0-9]$')))"


def sql_stem(t: str) -> str:
    rules = " ".join(f"WHEN ends_with({t}, '{s}') AND length({t}) >= {m + len(s)} THEN {t}[:length({t}) - {len(s)}]" for s, m in text.SUFFIXES)
    return f"CASE WHEN length({t}) <= 4 OR regexp_matches({t}, '^[0-9]+$') THEN {t} {rules} ELSE {t} END"


JOINED = "coalesce(title, '') || ' ' || coalesce(description, '')"
SQL_NORM = f"WITH {P.SQL_TEXTS}, norms AS (SELECT id, slug, hours, {JOINED} AS body, array_to_string({sql_tokens(JOINED)}, ' ') AS norm FROM texts)"
SQL_SHINGLES = SQL_NORM + """, sh AS (SELECT *, CASE WHEN norm = '' THEN CAST([] AS VARCHAR[]) WHEN length(norm) < 4 THEN [norm] ELSE list_distinct([norm[i:i + 3] FOR i IN range(1, length(norm) - 2)]) END AS shingles FROM norms)"""


def _norms(spark, sf):
    t = P.texts(spark, sf)
    return t.select("id", "slug", "hours", text.joined_text(F.col("title"), F.col("description")).alias("body")).withColumn("norm", text.normalize_turkish(F.col("body")))


@query(SQL_NORM + " SELECT id, norm FROM norms")
def fn_normalize_turkish(spark, sf):
    return _norms(spark, sf).select("id", "norm")


@query(SQL_NORM + f", w AS (SELECT DISTINCT unnest(string_split(norm, ' ')) AS token FROM norms) SELECT token, {sql_stem('token')} AS stem FROM w WHERE token <> ''")
def fn_stem_turkish(spark, sf):
    w = _norms(spark, sf).select(F.explode(F.split("norm", " ")).alias("token")).filter("token <> ''").distinct()
    return w.select("token", text.stem_turkish(F.col("token")).alias("stem"))


@query(SQL_SHINGLES + " SELECT id, len(shingles) AS n, sha1(array_to_string(list_sort(shingles), '|')) AS digest FROM sh")
def fn_shingles(spark, sf):
    return _norms(spark, sf).select("id", text.shingle_digest(F.col("norm")).alias("s")).select("id", "s.n", "s.digest")


@query(SQL_SHINGLES + " SELECT id, CASE WHEN norm <> '' THEN sha1(array_to_string(list_sort(shingles), '|')) END AS strict FROM sh")
def fn_strict_fingerprint(spark, sf):
    return _norms(spark, sf).select("id", text.strict_fingerprint(F.col("norm")).alias("strict"))


@query(SQL_NORM + " SELECT id, sha1(body) AS digest FROM norms")
def fn_sha1(spark, sf):
    return _norms(spark, sf).select("id", F.sha1(F.col("body").cast("binary")).alias("digest"))


@query(SQL_NORM + " SELECT id, CAST(('0x' || sha256(body)[1:8]) AS BIGINT) AS h FROM norms")
def fn_base_hash32(spark, sf):
    return _norms(spark, sf).select("id", text.base_hash32(F.col("body")).alias("h"))


def _sql_minhash() -> str:
    a, b = text.minhash_coefficients()
    rows = ", ".join(f"({i}, CAST({int(x)} AS DOUBLE), CAST({int(y)} AS DOUBLE))" for i, (x, y) in enumerate(zip(a, b, strict=True)))
    return (
        SQL_SHINGLES
        + f""", h AS (SELECT id, CAST(CAST(('0x' || sha256(s)[1:8]) AS BIGINT) AS DOUBLE) AS h FROM (SELECT id, unnest(shingles) AS s FROM sh)), k AS (SELECT * FROM (VALUES {rows}) t(slot, a, b)),
m AS (SELECT id, slot, CAST(min((a * (h % 2147483647) + b) % 2147483647) AS BIGINT) AS v FROM h CROSS JOIN k GROUP BY 1, 2), sig AS (SELECT id, string_agg(v, ',' ORDER BY slot) AS signature FROM m GROUP BY 1)"""
    )


@query(_sql_minhash() + f" SELECT sh.id, coalesce(signature, '{','.join(['4294967295'] * 64)}') AS signature FROM sh LEFT JOIN sig USING (id)")
def fn_minhash(spark, sf):
    s = _norms(spark, sf).select("id", text.minhash(F.col("norm")).alias("s"))
    return s.select("id", F.array_join(F.col("s").cast("array<string>"), ",").alias("signature"))


@query(_sql_minhash() + " SELECT x.id AS a, y.id AS b, round(count(*) FILTER (x.v = y.v) / 64.0, 9) AS jaccard FROM m x JOIN m y ON x.slot = y.slot AND y.id = x.id + 1 GROUP BY 1, 2")
def fn_jaccard_sig(spark, sf):
    """The signature of each document against that of the next id; empty texts, whose slots hold no number, are left out."""
    s = staged(_norms(spark, sf).select("id", text.minhash(F.nullif("norm", F.lit(""))).alias("s")), "signatures").filter("s is not null")
    a, b = s.select(F.col("id").alias("a"), F.col("s").alias("x")), s.select(F.col("id").alias("b"), F.col("s").alias("y"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", R(text.signature_jaccard(F.col("x"), F.col("y"))).alias("jaccard"))


_BARE = f"regexp_replace({_FOLDED.format(x='t')}, '[^a-z0-9]', '', 'g')"
_SPLIT = f"regexp_split_to_array(body, '[{text.BLANKS}.,;:!?()\\[\\]{{}}\"''`’‘“”«»\\-–—/\\\\|…]+')"


@query(SQL_NORM + f", w AS (SELECT DISTINCT unnest({_SPLIT}) AS t FROM norms) SELECT t AS raw, CASE WHEN length({_BARE}) >= 3 AND {_BARE} NOT IN ({_q(text.ENTITY_STOP_WORDS)}) THEN {_BARE} END AS token FROM w")
def fn_normalize_token(spark, sf):
    w = _norms(spark, sf).select(F.explode(F.split("body", text.ENTITY_BREAKS)).alias("raw")).distinct()
    return w.select("raw", text.normalize_token(F.col("raw")).alias("token"))


def _sql_entities() -> str:
    bare = f"list_transform({_SPLIT}, lambda t: {_BARE})"
    words = f"list_filter({bare}, lambda t: length(t) >= 3 AND t NOT IN ({_q(text.ENTITY_STOP_WORDS)}) AND t IN ({_q(dict.fromkeys(text.ENTITY_WORDS))}))"
    years = r"regexp_extract_all(body, '\b(19[5-9][0-9]|20[0-9][0-9])\b', 1)"
    shares = rf"list_transform(regexp_extract_all(body, '\b([0-9]{{1,3}})[{text.BLANKS}]*%', 1) || regexp_extract_all(body, '(?i)(?:y[üÜ]zde|yuzde)[{text.BLANKS}]*([0-9]{{1,3}})\b', 1), lambda n: 'pct' || n)"
    bridged = ", ".join(f"CASE WHEN regexp_matches(body, '(?i)(^|[^A-Za-z0-9]){en.replace(' ', '[' + text.BLANKS + ']+')}([^A-Za-z0-9]|$)') THEN '{tr}' END" for en, tr in text.ENTITY_BRIDGE.items())
    return SQL_NORM + f", ent AS (SELECT id, list_sort(list_distinct({words} || {years} || {shares} || list_filter([{bridged}], lambda v: v IS NOT NULL))) AS entities FROM norms)"


SQL_ENT = _sql_entities()


@query(SQL_ENT + " SELECT id, array_to_string(entities, ',') AS entities FROM ent")
def fn_extract_entities(spark, sf):
    return _norms(spark, sf).select("id", F.array_join(text.extract_entities(F.col("body")), ",").alias("entities"))


# ---- cleaning -------------------------------------------------------------------------------------------------------------


@query("SELECT page_id, " + "replace(" * 8 + "html" + "".join(f", '{a}', '{b}')" for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), ("&#39;", "''"), ("&#34;", '"'), ("&nbsp;", " "))) + " AS html FROM pages")
def fn_decode_entities_sql(spark, sf):
    return P.table(spark, sf, "pages").select("page_id", clean.decode_named_entities(F.col("html")).alias("html"))


@query("SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '<[^>]*>', '', 'g'), '<[^>]*>', '', 'g'), '<[^>]*>', '', 'g') AS plain FROM pages")
def fn_strip_tags(spark, sf):
    return P.table(spark, sf, "pages").select("page_id", clean.strip_tags(F.col("html")).alias("plain"))


@query("SELECT page_id, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS u FROM pages")
def fn_escape_xml(spark, sf):
    return P.table(spark, sf, "pages").select("page_id", clean.escape_xml(F.col("url")).alias("u"))


@query()
def fn_decode_entities(spark, sf):
    return P.table(spark, sf, "pages").select("page_id", clean.decode_entities("html").alias("html"))


@query()
def fn_clean_description(spark, sf):
    return P.table(spark, sf, "pages").select("page_id", clean.clean_description(F.col("html")).alias("description"))


def _sql_classify() -> str:
    low = f"lower(replace({JOINED} || ' ' || 'http://x.example/' || CASE WHEN id % 5 = 0 THEN 'spor/' WHEN id % 7 = 0 THEN 'dunya/' ELSE '' END || id, 'İ', 'i̇'))"
    path = "'http://x.example/' || CASE WHEN id % 5 = 0 THEN 'spor/' WHEN id % 7 = 0 THEN 'dunya/' ELSE '' END || id"
    cases = "".join(f" WHEN regexp_matches(u, '{p}') THEN '{c}'" for c, p in clean.URL_CATEGORIES) + "".join(f" WHEN regexp_matches(t, '{p}') THEN '{c}'" for c, p in clean.WORD_CATEGORIES)
    return f"WITH {P.SQL_TEXTS}, x AS (SELECT id, {low} AS t, {path} AS u FROM texts) SELECT id, CASE WHEN regexp_matches(t, '{clean.BREAKING_WORDS}') THEN 'son_dakika'{cases} ELSE 'genel' END AS category FROM x"


@query(_sql_classify())
def fn_classify_category(spark, sf):
    k = F.col("id")
    url = F.concat(F.lit("http://x.example/"), F.when(k % 5 == 0, "spor/").when(k % 7 == 0, "dunya/").otherwise(""), k.cast("string"))
    return P.texts(spark, sf).select("id", clean.classify_category(F.col("title"), F.col("description"), url).alias("category"))


_TRACK = _q(clean.TRACKING)


@query(f"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^([A-Za-z]+)://', 1) AS s, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '^www\\.', '') AS h, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS p, regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) AS q FROM pages),
r AS (SELECT *, CASE WHEN length(p) > 1 THEN regexp_replace(regexp_replace(p, '/{{2,}}', '/', 'g'), '/+$', '') WHEN p = '' THEN '/' ELSE p END AS pp, list_filter(string_split(q, '&'), lambda x: x <> '' AND lower(split_part(x, '=', 1)) NOT IN ({_TRACK})) AS kept FROM p)
SELECT page_id, s || '://' || h || pp || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS url FROM r""")
def fn_canonicalize_url(spark, sf):
    return P.table(spark, sf, "pages").select("page_id", clean.canonical_url(F.col("url")).alias("url"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN 'https://b.example/r/' || page_id ELSE 'https://b.example/x' || page_id END AS url FROM pages")
def fn_absolutise_url(spark, sf):
    k = F.col("page_id")
    link = F.when(k % 3 == 0, F.col("url")).when(k % 3 == 1, F.concat(F.lit("/r/"), k.cast("string"))).otherwise(F.concat(F.lit("x"), k.cast("string")))
    return P.table(spark, sf, "pages").select("page_id", clean.absolute_url(link, F.lit("https://b.example//")).alias("url"))


_IMG = """CASE page_id % 4 WHEN 0 THEN '<meta property="og:image" content="https://i.example/' || page_id || '.jpg">' WHEN 1 THEN '<meta content="https://i.example/alt' || page_id || '.jpg" property="og:image">' WHEN 2 THEN '<meta name="twitter:image" content="https://i.example/tw' || page_id || '.jpg">' ELSE '"image": {"url": "https://i.example/ld' || page_id || '.jpg"}' END"""


def _html(spark, sf):
    k, n = F.col("page_id") % 4, F.col("page_id").cast("string")
    img = (F.when(k == 0, F.concat(F.lit('<meta property="og:image" content="https://i.example/'), n, F.lit('.jpg">'))).when(k == 1, F.concat(F.lit('<meta content="https://i.example/alt'), n, F.lit('.jpg" property="og:image">')))
           .when(k == 2, F.concat(F.lit('<meta name="twitter:image" content="https://i.example/tw'), n, F.lit('.jpg">'))).otherwise(F.concat(F.lit('"image": {"url": "https://i.example/ld'), n, F.lit('.jpg"}'))))
    return P.table(spark, sf, "pages").select("page_id", F.concat(img, F.col("html")).alias("html"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://i.example/' || page_id || '.jpg' WHEN 1 THEN 'https://i.example/alt' || page_id || '.jpg' END AS image FROM pages")
def fn_og_image(spark, sf):
    return _html(spark, sf).select("page_id", clean.og_image(F.col("html")).alias("image"))


@query("SELECT page_id, 'https://i.example/' || CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'alt' WHEN 2 THEN 'tw' ELSE 'ld' END || page_id || '.jpg' AS image FROM pages")
def fn_hero_image(spark, sf):
    return _html(spark, sf).select("page_id", clean.hero_image(F.col("html")).alias("image"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://e.example/' || page_id WHEN 1 THEN 'https://m.example/' || page_id ELSE 'https://h.example/photo' || page_id || '.jpg' END AS image FROM pages")
def fn_extract_image(spark, sf):
    k, n = F.col("page_id") % 4, F.col("page_id").cast("string")
    enclosure, media = F.concat(F.lit("https://e.example/"), n), F.when(k == 1, F.concat(F.lit("https://m.example/"), n))
    html = F.concat(F.lit('<p><IMG class="x" src="https://h.example/photo'), n, F.lit('.jpg"></p>'))
    none = F.lit(None).cast("string")
    return P.table(spark, sf, "pages").select("page_id", clean.feed_image(enclosure, F.when(k == 0, "image/png").otherwise("audio/mp3"), media, none, none, F.lit("https://x.example/logo.png"), html).alias("image"))


@query("SELECT p_partkey, CASE WHEN length(p_name) > 8 THEN rtrim(p_name[:7]) || '…' ELSE p_name END AS short FROM part")
def fn_truncate(spark, sf):
    return P.table(spark, sf, "part").select("p_partkey", clean.truncate(F.col("p_name"), 8).alias("short"))


@query("SELECT p_partkey, trim(regexp_replace('\"' || p_name || '”', '^[\"''“‘]|[\"''”’]$', '', 'g')) AS bare FROM part")
def fn_strip_quotes(spark, sf):
    return P.table(spark, sf, "part").select("p_partkey", clean.strip_quotes(F.concat(F.lit('"'), "p_name", F.lit("”"))).alias("bare"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN '10.0.0.' || user_id WHEN 1 THEN '192.0.2.' || user_id ELSE 'anon' END AS client FROM events")
def fn_client_key(spark, sf):
    k, u = F.col("event_id") % 3, F.col("user_id").cast("string")
    forwarded = F.when(k == 0, F.concat(F.lit(" 10.0.0."), u, F.lit(" , 1.1.1.1")))
    return P.table(spark, sf, "events").select("event_id", clean.client_key(forwarded, F.when(k == 1, F.concat(F.lit("192.0.2."), u))).alias("client"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'windows-1254' WHEN 1 THEN 'iso-8859-9' END AS charset FROM events")
def fn_charset_sniff(spark, sf):
    from prismfeed.sources.feeds import header_charset, prolog_charset

    k = F.col("event_id") % 3
    header = F.when(k == 0, 'text/xml; Charset = "Windows-1254"').otherwise("text/xml")
    body = F.when(k == 1, "<?xml version='1.0' encoding='ISO-8859-9'?>").otherwise("<rss/>")
    return P.table(spark, sf, "events").select("event_id", F.coalesce(header_charset(header), prolog_charset(body.cast("binary"))).alias("charset"))


# ---- dates and numbers ----------------------------------------------------------------------------------------------------

_AGO = f"greatest(0, (epoch_us({NOW}) - epoch_us(l_shipdate)) / 1e6)"


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN {_AGO} < 60 THEN 'az önce' WHEN {_AGO} < 3600 THEN CAST(floor({_AGO} / 60) AS BIGINT) || ' dakika önce' WHEN {_AGO} < 86400 THEN CAST(floor({_AGO} / 3600) AS BIGINT) || ' saat önce' WHEN {_AGO} < 604800 THEN CAST(floor({_AGO} / 86400) AS BIGINT) || ' gün önce'
WHEN {_AGO} < 2592000 THEN CAST(floor({_AGO} / 604800) AS BIGINT) || ' hafta önce' WHEN {_AGO} < 31536000 THEN CAST(floor({_AGO} / 2592000) AS BIGINT) || ' ay önce' ELSE CAST(floor({_AGO} / 31536000) AS BIGINT) || ' yıl önce' END AS ago FROM lineitem""")
def fn_time_ago_tr(spark, sf):
    return P.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", scalar.time_ago_tr(F.col("l_shipdate").cast("timestamp"), P.as_of()).alias("ago"))


@query(f"SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN '{P.AS_OF}' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS at FROM orders")
def fn_parse_date(spark, sf):
    d, k = F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey") % 3
    raw = F.when(k == 0, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss")).when(k == 1, F.date_format(d, "EEE, d MMM yyyy HH:mm:ss 'GMT'")).otherwise("yesterday")
    return P.table(spark, sf, "orders").select("o_orderkey", P.stamp(clean.parse_date(raw, P.as_of())).alias("at"))


@query(f"SELECT event_id, round(abs(epoch_us({NOW}) - epoch_us(ts)) / 3.6e9, 9) AS hours FROM events")
def fn_hours_between(spark, sf):
    return P.table(spark, sf, "events").select("event_id", R(scalar.hours_between(F.col("ts").cast("timestamp"), P.as_of())).alias("hours"))


@query("SELECT event_id, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour FROM events", name="fn_utc_day")
@query("SELECT event_id, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour FROM events", name="fn_hour_floor")
def _floors(spark, sf):
    return P.table(spark, sf, "events").select("event_id", F.date_format(F.date_trunc("day", "ts"), "yyyy-MM-dd").alias("day"), P.stamp(F.date_trunc("hour", "ts")).alias("hour"))


@query(f"SELECT event_id, epoch_us({NOW}) - epoch_us(ts) > 172800000000 AS aging FROM events")
def fn_is_aging(spark, sf):
    return P.table(spark, sf, "events").select("event_id", (F.unix_micros(P.as_of()) - F.unix_micros(F.col("ts").cast("timestamp")) > 172_800_000_000).alias("aging"))


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 0 ELSE least(1, greatest(0, value / 10 - 1)) END AS x FROM events")
def fn_clip01(spark, sf):
    v = F.when(F.col("event_id") % 7 == 0, F.lit(float("inf"))).otherwise(F.col("value") / 10 - 1)
    return P.table(spark, sf, "events").select("event_id", scalar.clip01(v).alias("x"))


@query("SELECT event_id, floor((value - 20) * 10 + 0.5) / 10 AS x FROM events")
def fn_js_round2(spark, sf):
    return P.table(spark, sf, "events").select("event_id", scalar.js_round(F.col("value") - 20, 1).alias("x"))


@query("SELECT s_suppkey, CAST(CASE WHEN s_suppkey % 9 = 0 THEN 0.85 ELSE 1.0 END AS DOUBLE) AS p FROM supplier")
def fn_source_penalty(spark, sf):
    slug = F.when(F.col("s_suppkey") % 9 == 0, "haberler-com").otherwise("other")
    return P.table(spark, sf, "supplier").select("s_suppkey", scalar.penalty(slug, F.lit(None).cast("string")).alias("p"))


@query("SELECT event_id, coalesce(CASE WHEN event_id % 5 = 0 THEN NULL ELSE value / 50 END >= 0.48, FALSE) AS ok FROM events")
def fn_is_match(spark, sf):
    return P.table(spark, sf, "events").select("event_id", scalar.is_match(F.when(F.col("event_id") % 5 != 0, F.col("value") / 50)).alias("ok"))


@query(f"WITH {P.SQL_MEMBERS} SELECT bias, {P.sql_zone('bias')} AS zone, count(*) AS n FROM members GROUP BY 1, 2")
def fn_zone_of(spark, sf):
    from prismfeed.schema import zone_of

    return P.members(spark, sf).groupBy("bias", zone_of(F.col("bias")).alias("zone")).agg(F.count("*").alias("n"))


# ---- TF-IDF and ensemble over whole texts ---------------------------------------------------------------------------------

SQL_TFIDF = SQL_NORM + f""", w AS (SELECT id, unnest(list_filter(string_split(norm, ' '), lambda t: t <> '')) AS t FROM norms), tf AS (SELECT id, {sql_stem("t")} AS term, count(*) AS tf FROM w GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*) AS n FROM norms), v AS (SELECT id, term, tf * (ln((n + 1) / (df + 1)) + 1) AS w FROM tf JOIN df USING (term), n), l AS (SELECT id, sqrt(sum(w * w)) AS norm FROM v GROUP BY 1)"""


@query(SQL_TFIDF + " SELECT v.id, term, round(w, 7) AS w, round(norm, 6) AS norm FROM v JOIN l USING (id)")
def fn_tfidf_weight(spark, sf):
    return C.tfidf(_norms(spark, sf)).select("id", "term", F.round("w", 7).alias("w"), F.round("norm", 6).alias("norm"))


SQL_PAIRS = SQL_ENT + f""", e AS (SELECT id, unnest(entities) AS e FROM ent), pairs AS (SELECT a, b, shared FROM (SELECT x.id AS a, y.id AS b, count(*) AS shared FROM e x JOIN e y ON x.e = y.e AND x.id < y.id GROUP BY 1, 2 HAVING count(*) >= 2) JOIN norms na ON na.id = a JOIN norms nb ON nb.id = b WHERE abs(na.hours - nb.hours) <= 48)"""


def _articles(spark, sf):
    """Articles with their features, computed once for all steps of a query."""
    hour = 3_600_000_000
    t = P.texts(spark, sf).withColumn("published_at", F.timestamp_micros((F.unix_micros(P.as_of()) + F.col("hours") * hour).cast("long")))
    return staged(C.features(t).drop("title", "description"), "articles")


@query(SQL_PAIRS + " SELECT a, b, shared FROM pairs")
def jn_entity_candidates(spark, sf):
    return C.entity_pairs(_articles(spark, sf))


@query(SQL_SHINGLES + ", f AS (SELECT id, sha1(array_to_string(list_sort(shingles), '|')) AS strict FROM sh WHERE norm <> ''), g AS (SELECT strict, min(id) AS first FROM f GROUP BY 1 HAVING count(*) > 1) SELECT id, first FROM f JOIN g USING (strict) WHERE id > first")
def jn_fp_equi(spark, sf):
    f = staged(_norms(spark, sf).select("id", text.strict_fingerprint(F.col("norm")).alias("strict")), "fingerprints").filter("strict is not null")
    first = f.groupBy("strict").agg(F.min("id").alias("first"))
    return f.join(first, "strict").filter("id > first").select("id", "first")


SQL_COS = SQL_PAIRS + SQL_TFIDF.removeprefix(SQL_NORM) + """, c AS (SELECT a, b, sum(x.w * y.w / (lx.norm * ly.norm)) AS cosine FROM pairs JOIN v x ON x.id = a JOIN v y ON y.id = b AND y.term = x.term JOIN l lx ON lx.id = a JOIN l ly ON ly.id = b GROUP BY 1, 2)"""


@query(SQL_COS + " SELECT pairs.a, pairs.b, round(coalesce(cosine, 0), 7) AS cosine FROM pairs LEFT JOIN c ON c.a = pairs.a AND c.b = pairs.b")
def jn_pairwise_tfidf(spark, sf):
    a = _articles(spark, sf)
    return C.cosines(C.tfidf(a), staged(C.entity_pairs(a), "pairs")).withColumn("cosine", F.round("cosine", 7))


_SQL_MINHASHES = _sql_minhash().removeprefix(SQL_NORM)
SQL_SCORE = (
    SQL_ENT
    + _SQL_MINHASHES
    + ", st AS (SELECT id, CASE WHEN norm <> '' THEN sha1(array_to_string(list_sort(shingles), '|')) END AS strict FROM sh), copies AS (SELECT min(id) OVER (PARTITION BY strict) AS a, id AS b FROM st WHERE strict IS NOT NULL)"
    + SQL_COS.removeprefix(SQL_ENT).replace("pairs AS (SELECT a, b, shared", "alike AS (SELECT a, b, shared", 1).replace(SQL_TFIDF.removeprefix(SQL_NORM), ", pairs AS (SELECT a, b, max(shared) AS shared FROM (SELECT * FROM alike UNION ALL SELECT a, b, 0 FROM copies WHERE a < b) GROUP BY 1, 2)" + SQL_TFIDF.removeprefix(SQL_NORM))
    + """, j AS (SELECT a, b, count(*) FILTER (x.v = y.v) / 64.0 AS j FROM pairs JOIN m x ON x.id = a JOIN m y ON y.id = b AND y.slot = x.slot GROUP BY 1, 2),
raw AS (SELECT pairs.a, pairs.b, coalesce(sa.strict = sb.strict, FALSE) AS auto, coalesce(j.j, 0) AS j, pairs.shared / greatest(3, least(len(ea.entities), len(eb.entities))) AS er, coalesce(cosine, 0) AS cosine, abs(na.hours - nb.hours) AS h,
  CASE WHEN na.slug = 'haberler-com' OR nb.slug = 'haberler-com' THEN 0.85 ELSE 1.0 END AS pen FROM pairs JOIN st sa ON sa.id = pairs.a JOIN st sb ON sb.id = pairs.b JOIN ent ea ON ea.id = pairs.a JOIN ent eb ON eb.id = pairs.b
  JOIN norms na ON na.id = pairs.a JOIN norms nb ON nb.id = pairs.b LEFT JOIN j ON j.a = pairs.a AND j.b = pairs.b LEFT JOIN c ON c.a = pairs.a AND c.b = pairs.b),
scored AS (SELECT a, b, auto, round(CASE WHEN auto THEN pen ELSE least(1, greatest(CASE WHEN j >= 0.5 THEN 0.6 + 0.4 * j ELSE 0.5 * j END, 0.4 * least(1, cosine) + 0.6 * least(1, least(1, er) * greatest(0.5, 1 - h / 6)))) * greatest(0, 1 - h / 48) * pen END, 7) AS score FROM raw)"""
)


def _scored(spark, sf):
    a = _articles(spark, sf)
    p = staged(C.entity_pairs(a).select("a", "b").union(C.fingerprint_pairs(a)).distinct(), "pairs")
    return a, C.score_pairs(p, a, a, C.cosines(C.tfidf(a), p))


@query(SQL_SCORE + " SELECT a, b, auto, score FROM scored", name="ens_score_pairs")
@query(SQL_SCORE + " SELECT a, b, auto, score FROM scored", name="fn_ensemble_score")
def _scores(spark, sf):
    return _scored(spark, sf)[1].select("a", "b", "s.auto", F.round("s.score", 7).alias("score"))


@query(SQL_SCORE + ", r AS (SELECT a, b, score, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rn FROM scored WHERE score >= 0.48) SELECT a, b, score FROM r WHERE rn = 1")
def ens_best_match(spark, sf):
    """Word vectors meet only for pairs that could reach the threshold with them."""
    a = _articles(spark, sf)
    p = staged(C.could_match(C.entity_pairs(a).select("a", "b").union(C.fingerprint_pairs(a)).distinct(), a, a), "pairs")
    s = C.score_pairs(p, a, a, C.cosines(C.tfidf(a), p)).withColumn("s", F.struct(F.round("s.score", 7).alias("score")))
    return C.best_match(s)


@query()
def ens_assign(spark, sf):
    """Politics articles as they are published, in three slices of time; a desk for each language."""
    lang = P.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang")
    rows = _articles(spark, sf).join(lang, "id", "left")
    category = F.when(F.col("id") % 5 == 0, "spor").when(F.col("id") % 5 == 1, "son_dakika").otherwise("politika")
    log = stateful.story_rows(rows, F.coalesce("lang", F.lit("tr")), category)
    return replayed(spark, log, "published_at", stateful.assign_stories, "id long, cluster_id long, how string")


SQL_CANDIDATES = SQL_ENT + ", st AS (SELECT id, CASE WHEN norm <> '' THEN sha1(array_to_string(list_sort(CASE WHEN length(norm) < 4 THEN [norm] ELSE list_distinct([norm[i:i + 3] FOR i IN range(1, length(norm) - 2)]) END), '|')) END AS strict FROM norms)" + """,
m AS (SELECT id, (id + 1000) // 5 AS cluster_id, hours FROM norms WHERE hours < 60), ctx AS (SELECT cluster_id FROM m GROUP BY 1 HAVING abs(max(hours) - 60) <= 48 ORDER BY max(hours) DESC, cluster_id LIMIT 60), cm AS (SELECT m.* FROM m JOIN ctx USING (cluster_id)),
n AS (SELECT id FROM norms WHERE hours >= 60), fp AS (SELECT DISTINCT n.id, cluster_id FROM n JOIN st x ON x.id = n.id JOIN st y ON y.strict = x.strict JOIN cm ON cm.id = y.id), ee AS (SELECT id, unnest(entities) AS e FROM ent),
ce AS (SELECT DISTINCT cluster_id, e FROM cm JOIN ee USING (id)), byent AS (SELECT n.id, cluster_id, count(*) AS weight FROM n JOIN ee USING (id) JOIN ce USING (e) GROUP BY 1, 2 HAVING count(*) >= 2),
w AS (SELECT id, cluster_id, max(weight) AS weight FROM (SELECT id, cluster_id, 1073741824 AS weight FROM fp UNION ALL SELECT * FROM byent) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY weight DESC, cluster_id) AS place FROM w)"""


@query(SQL_CANDIDATES + " SELECT id, cluster_id, CAST(weight AS INTEGER) AS weight, CAST(place AS INTEGER) AS place FROM r WHERE place <= 20")
def ens_candidates(spark, sf):
    """Articles of hour 60 on against the newest 60 clusters (of five articles each) of the 48 hours before."""
    a = _articles(spark, sf)
    members = a.filter("hours < 60").withColumn("cluster_id", F.floor((F.col("id") + 1000) / 5))
    now = F.timestamp_micros(F.unix_micros(P.as_of()) + 60 * 3_600_000_000)
    return C.candidates(a.filter("hours >= 60"), C.recent_clusters(members, now)).select("id", "cluster_id", "weight", "place")


@query(SQL_ENT + """, ee AS (SELECT id, unnest(entities) AS e FROM ent), ce AS (SELECT DISTINCT (id + 1000) // 5 AS cluster_id, e FROM ee), w AS (SELECT id, cluster_id, count(*) AS shared FROM ee JOIN ce USING (e) GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT id, cluster_id, CAST(shared AS INTEGER) AS shared, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY shared DESC, cluster_id) AS place FROM w) WHERE place <= 20""")
def jn_entity_top20(spark, sf):
    """For every article the twenty of all clusters (of five articles each) that share most entities with it."""
    t = P.texts(spark, sf)
    a = staged(t.select("id", text.extract_entities(text.joined_text(F.col("title"), F.col("description"))).alias("entities")), "articles")  # no other feature is asked for
    return C.best_clusters(a, a.select(F.floor((F.col("id") + 1000) / 5).alias("cluster_id"), "entities"))


@query(f"WITH {P.SQL_MEMBERS}, t AS (SELECT cluster_id, 'Başlık ' || id AS t FROM members), r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY length(t), t) AS rn FROM t) SELECT cluster_id, t[:80] AS title FROM r WHERE rn = 1")
def udf_llm_rewrite(spark, sf):
    return C.shortest_titles(P.members(spark, sf).select("cluster_id", F.concat(F.lit("Başlık "), F.col("id").cast("string")).alias("title")))
