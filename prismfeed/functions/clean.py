"""Cleaning of feed texts, URLs, images and dates."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Blanks of trim, named entities, image words, tracking parameters, section prefixes, category words.
BLANKS = r"[\s\u00a0\ufeff\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}
NO_IMAGE = "favicon|icon|logo|pixel|tracker|1x1|spacer"
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref", "ref_source", "referrer", "source", "from", "st", "amp")
SECTIONS = {"10haber": "siyaset|gundem|populer|ekonomi|dunya|spor|yasam", "haberler": "gundem|siyaset|ekonomi|dunya|spor|yasam|magazin"}
SPORTS_SLUGS = ("fotomac", "fotospor", "a-spor", "ntv-spor", "kontraspor", "ajansspor")
BREAKING_WORDS = r"son\s*dakika|flaş\s*haber|breaking|acil|sondakika"
URL_CATEGORIES = (
    ("spor", "/spor/|/sport"), ("politika", "/siyaset/|/politika/|/politi"), ("ekonomi", "/ekonomi/|/finans/|/economy"), ("teknoloji", "/teknoloji/|/tech"), ("dunya", "/dunya/|/world/|/global"),
    ("yasam", "/yasam/|/life/|/saglik/|/egitim"),
)
WORD_CATEGORIES = (
    ("spor", r"futbol|süper\s*lig|galatasaray|fenerbahçe|beşiktaş|trabzonspor|basketbol|voleybol|şampiyonlar\s*ligi|milli\s*takım|gol|maç|transfer|teknik\s*direktör|stadyum|olimpiyat|uefa|fifa|tff"),
    ("politika", r"erdoğan|chp|akp|ak\s*parti|mhp|hdp|tbmm|meclis|cumhurbaşkan|bakan(lık)?|seçim|oy|muhalefet|hükümet|vekil|siyaset|anayasa|parti\s*genel|içişleri|dışişleri"),
    ("dunya", r"abd|amerika|rusya|ukrayna|çin|avrupa|nato|bm|birleşmiş\s*milletler|eu|ingiltere|almanya|fransa|iran|israil|filistin|suriye|irak|dünya|uluslararası|küresel"),
    ("ekonomi", r"dolar|euro|tl|enflasyon|faiz|borsa|merkez\s*bankası|bist|ekonomi|ihracat|ithalat|büyüme|gsyih|vergi|maaş|asgari\s*ücret|zam|piyasa|kur"),
    ("teknoloji", r"yapay\s*zeka|ai|iphone|samsung|google|microsoft|apple|siber|yazılım|uygulama|robot|teknoloji|dijital|startup|kripto|bitcoin|blockchain"),
    ("yasam", r"sağlık|eğitim|üniversite|deprem|hava\s*durumu|trafik|kaza|yangın|sel|çevre|kültür|sanat|müzik|sinema|dizi|magazin|yaşam"),
)
SEO_TITLE = r"(?i)kimdir|ka[çÇ] ya[şŞ]ında|nedir\?|ne zaman|ka[çÇ] bin|ka[çÇ] tl|son dakika.*?:|canlı|ne dedi"
EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"


def trim_blanks(x: Column) -> Column:
    return F.regexp_replace(x, f"^{BLANKS}+|{BLANKS}+$", "")


_ENTITY = re.compile(r"&(amp|lt|gt|quot|apos|nbsp|#[0-9]+|#x[0-9a-fA-F]+);")


def _decoded(m: re.Match) -> str:
    name = m[1]
    if name[0] != "#":
        return NAMED[name]
    code = int(name[2:], 16) if name[1] == "x" else int(name[1:])
    return chr(code) if code <= 0x10FFFF and not 0xD800 <= code < 0xE000 else m[0]


@F.pandas_udf(T.StringType())
def decode_entities(text: pd.Series) -> pd.Series:
    """Named and numeric entities, each decoded once, so that no result is read as an entity again."""
    return text.map(lambda t: None if t is None else _ENTITY.sub(_decoded, t))


def decode_named_entities(x: Column) -> Column:
    """Sequential replacement of the named entities, the ampersand first."""
    for name, plain in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#34;", '"'), ("&nbsp;", " ")):
        x = F.replace(x, F.lit(name), F.lit(plain))
    return x


def strip_tags(x: Column) -> Column:
    """The text without tags; once is enough, as no "<" that is left has a ">" behind it."""
    return F.regexp_replace(x, "<[^>]*>", "")


def clean_description(raw: Column) -> Column:
    """Decoded, without tags, trimmed; null when empty, cut to 497 characters and an ellipsis beyond 500."""
    text = trim_blanks(strip_tags(decode_entities(raw)))
    return F.when(text == "", None).when(F.length(text) > 500, F.concat(F.left(text, F.lit(497)), F.lit("..."))).otherwise(text)


def clean_title(raw: Column) -> Column:
    return trim_blanks(strip_tags(decode_entities(trim_blanks(raw))))


def classify_category(title: Column, description: Column, url: Column, slug: Column | None = None) -> Column:
    """Breaking news by words, then sections of the URL, then words in order, else genel. Words match anywhere in a text."""
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit("")), F.coalesce(url, F.lit(""))))
    path = F.lower(F.coalesce(url, F.lit("")))
    out = F.when(slug.isin(*SPORTS_SLUGS), "spor").when(text.rlike(BREAKING_WORDS), "son_dakika") if slug is not None else F.when(text.rlike(BREAKING_WORDS), "son_dakika")
    for name, pattern in URL_CATEGORIES:
        out = out.when(path.rlike(pattern), name)
    for name, pattern in WORD_CATEGORIES:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise("genel")


def valid_image(url: Column, absolute: bool = False) -> Column:
    ok = (F.length(url) >= 10) & ~url.startswith("data:") & ~url.rlike(f"(?i){NO_IMAGE}")
    return F.coalesce(ok & url.rlike("(?i)^https?://") if absolute else ok, F.lit(False))


def _first(html: Column, *patterns: str) -> Column:
    return F.coalesce(*[F.nullif(F.regexp_extract(html, p, 1), F.lit("")) for p in patterns])


def _meta(attribute: str, value: str, both: bool = True) -> list[str]:
    q, v = "[\"']", "([^\"']+)"
    forward = rf"(?i)<meta\s+(?:[^>]*?\s+)?{attribute}={q}{value}{q}\s+content={q}{v}{q}"
    backward = rf"(?i)content={q}{v}{q}\s+(?:[^>]*?\s+)?{attribute}={q}{value}{q}"
    return [forward, backward] if both else [forward]


def og_image(html: Column) -> Column:
    return _first(html, *_meta("property", "og:image"))


def hero_image(html: Column) -> Column:
    """The first valid image of: Open Graph, Twitter, itemprop, link and JSON-LD in its three forms."""
    link = r"(?i)<link\s+(?:[^>]*?\s+)?rel=[\"']image_src[\"']\s+href=[\"']([^\"']+)[\"']"
    ld = [rf'(?i)"image"\s*:\s*\{{[^}}]*?"{k}"\s*:\s*"(https?:[^"]+)"' for k in ("contentUrl", "url")] + [r'(?i)"image"\s*:\s*"(https?:[^"]+)"']
    found = [og_image(html), _first(html, *_meta("name", "twitter:image")), _first(html, *_meta("itemprop", "image", both=False)), _first(html, link), *[_first(html, p) for p in ld]]
    return F.coalesce(*[F.when(valid_image(x, absolute=True), x) for x in found])


def feed_image(enclosure_url: Column, enclosure_type: Column, content: Column, thumbnail: Column, group: Column, item: Column, html: Column) -> Column:
    """The image of a feed item: enclosure (an image or untyped), media fields, the item's own and the first in its HTML, the last two if valid."""
    enclosed = F.when(F.coalesce(enclosure_type, F.lit("")).rlike("^$|^image/"), enclosure_url)
    inner = F.nullif(F.regexp_extract(html, "(?i)<img[^>]+src=[\"']([^\"']+)[\"']", 1), F.lit(""))
    return F.coalesce(enclosed, content, thumbnail, group, F.when(valid_image(item), item), F.when(valid_image(inner), inner))


def canonical_url(url: Column, slug: Column | None = None) -> Column:
    """Host in lower case without www., no tracking parameters, quotes, doubled or final slashes or fragment; malformed URLs as they are."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, "^[A-Za-z]+://([^/?#]*)", 1)), "^www\\.", "")
    scheme = F.lower(F.regexp_extract(url, "^([A-Za-z]+)://", 1))
    path = F.regexp_replace(F.regexp_extract(url, "^[A-Za-z]+://[^/?#]*([^?#]*)", 1), "(?i)%27|'", "")
    if slug is not None:
        for name, sections in SECTIONS.items():
            path = F.when(slug == name, F.regexp_replace(path, f"^/({sections})/", "/")).otherwise(path)
    path = F.regexp_replace(path, "/{2,}", "/")
    path = F.when(F.length(path) > 1, F.regexp_replace(path, "/+$", "")).otherwise(path)
    path = F.when(path == "", "/").otherwise(path)
    query = F.regexp_extract(url, "^[^?#]*\\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(url.rlike("^(?i)https?://[^/?#]+"), F.concat(scheme, F.lit("://"), host, path, tail)).otherwise(url)


def absolute_url(link: Column, base: Column) -> Column:
    stem = F.regexp_replace(base, "/+$", "")
    return F.when(link.rlike("(?i)^https?://"), link).when(link.startswith("/"), F.concat(stem, link)).otherwise(F.concat(stem, F.lit("/"), F.regexp_replace(link, "^/+", "")))


def escape_xml(x: Column) -> Column:
    for plain, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        x = F.replace(x, F.lit(plain), F.lit(name))
    return x


def truncate(x: Column, most: int) -> Column:
    """At most `most` characters, the last an ellipsis when cut; blanks before it go."""
    return F.when(F.length(x) > most, F.concat(F.rtrim(F.left(x, F.lit(most - 1))), F.lit("…"))).otherwise(x)


def strip_quotes(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, "^[\"'“‘]|[\"'”’]$", ""))


def valid_email(x: Column) -> Column:
    clean = F.lower(F.trim(x))
    return F.coalesce((F.length(clean) <= 254) & clean.rlike(EMAIL), F.lit(False))


def client_key(forwarded: Column, real_ip: Column) -> Column:
    first = F.nullif(F.trim(F.split(forwarded, ",")[0]), F.lit(""))
    return F.coalesce(first, F.nullif(real_ip, F.lit("")), F.lit("anon"))


def parse_date(raw: Column, as_of: Column) -> Column:
    """RFC 822 or ISO dates; missing or malformed ones become as_of."""
    iso = F.try_to_timestamp(raw)
    rfc = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(raw, "^[A-Za-z]+,\\s*", ""), "(GMT|UTC|Z)$", "+0000"), F.lit("d MMM yyyy HH:mm:ss Z"))
    return F.coalesce(iso, rfc, as_of)


def logo_url(logo: Column, url: Column) -> Column:
    host = F.regexp_replace(url, r"^https?://(www\.)?([^/]+).*$", "$2")
    return F.coalesce(logo, F.concat(F.lit("https://www.google.com/s2/favicons?domain="), host, F.lit("&sz=64")))
