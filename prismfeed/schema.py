"""Domains and table schemas shared by all operators."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bias categories in key order, their zones, left-to-right order, labels, categories.
BIAS_KEYS = ("pro_government", "gov_leaning", "state_media", "center", "opposition_leaning", "opposition", "nationalist", "islamist_conservative", "pro_kurdish", "international")
BIAS_ORDER = ("pro_government", "state_media", "gov_leaning", "islamist_conservative", "center", "international", "pro_kurdish", "opposition_leaning", "opposition", "nationalist")
BIAS_ZONE = {
    "pro_government": "iktidar", "gov_leaning": "iktidar", "state_media": "iktidar", "islamist_conservative": "iktidar", "nationalist": "iktidar",
    "center": "bagimsiz", "international": "bagimsiz", "pro_kurdish": "bagimsiz", "opposition_leaning": "muhalefet", "opposition": "muhalefet",
}
ZONES = ("iktidar", "bagimsiz", "muhalefet")
OPPOSITE = {"iktidar": "muhalefet", "muhalefet": "iktidar"}
ZONE_LABELS = {"iktidar": "iktidara yakın", "muhalefet": "muhalefet yanlısı", "bagimsiz": "bağımsız"}
CATEGORIES = ("son_dakika", "politika", "dunya", "ekonomi", "spor", "teknoloji", "yasam", "genel")
POLITICS = ("politika", "son_dakika")

_S, _TS, _I = T.StringType(), T.TimestampType(), T.IntegerType()


def _struct(**kinds) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in kinds.items()])


SOURCES = _struct(id=_S, name=_S, slug=_S, url=_S, rss_url=_S, bias=_S, logo_url=_S, active=T.BooleanType(), created_at=_TS)
ARTICLES = _struct(
    id=_S, source_id=_S, title=_S, description=_S, url=_S, image_url=_S, published_at=_TS, content_hash=_S, category=_S, fingerprint=_S,
    entities=T.ArrayType(_S), body_excerpt=_S, image_backfill_attempted_at=_TS, image_backfill_attempts=_I, created_at=_TS,
)
CLUSTERS = _struct(
    id=_S, title_tr=_S, title_en=_S, summary_tr=_S, summary_en=_S, bias_distribution=T.MapType(_S, _I), is_blindspot=T.BooleanType(), blindspot_side=_S, article_count=_I,
    first_published=_TS, created_at=_TS, updated_at=_TS, title_tr_original=_S, title_tr_neutral=_S, title_neutral_at=_TS,
)
CLUSTER_ARTICLES = _struct(cluster_id=_S, article_id=_S)
STORIES = _struct(id=_S, slug=_S, title=_S, display_order=_I)
STORY_STANCES = _struct(story_id=_S, source_id=_S, stance=_S, note=_S)
SUBSCRIBERS = _struct(email=_S, created_at=_TS, confirmed=T.BooleanType())
MESSAGES = _struct(msg_id=T.LongType(), read_ct=_I, enqueued_at=_TS, vt=_TS, message=_S)


def zone_of(bias: Column) -> Column:
    """The zone of a bias, null for unknown ones."""
    return F.create_map(*[F.lit(x) for x in chain(*BIAS_ZONE.items())])[bias]


def opposite_of(zone: Column) -> Column:
    return F.when(zone == "iktidar", "muhalefet").when(zone == "muhalefet", "iktidar")


def in_politics(category: Column) -> Column:
    return category.isin(*POLITICS)
