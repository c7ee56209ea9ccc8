"""Dates, rounding, scores and other scalar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds and weights of the pair score, source multipliers.
MATCH, WINDOW_HOURS, SOFT_JACCARD, TFIDF_WEIGHT, ENTITY_WEIGHT, ENTITY_FLOOR, FRESH_HOURS = 0.48, 48, 0.5, 0.40, 0.60, 3, 6
PENALTIES = {"haberler-com": 0.85}
MINUTE, HOUR, DAY = 60, 3600, 86400


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 1e6


def hours_between(a: Column, b: Column) -> Column:
    return F.abs(F.unix_micros(a) - F.unix_micros(b)) / 3.6e9


def time_ago_tr(then: Column, now: Column) -> Column:
    """Elapsed time in Turkish words; future times count as now, a missing one is empty."""
    s = F.greatest(F.lit(0.0), seconds_between(now, then))
    out = F.when(then.isNull(), "").when(s < MINUTE, "az önce")
    for below, unit, word in ((HOUR, MINUTE, "dakika"), (DAY, HOUR, "saat"), (7 * DAY, DAY, "gün"), (30 * DAY, 7 * DAY, "hafta"), (365 * DAY, 30 * DAY, "ay"), (None, 365 * DAY, "yıl")):
        text = F.concat(F.floor(s / unit).cast("string"), F.lit(f" {word} önce"))
        out = out.otherwise(text) if below is None else out.when(s < below, text)
    return out


def js_round(x: Column, digits: int = 0) -> Column:
    """Half up, also for negative numbers."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def clip01(x: Column) -> Column:
    """Into [0, 1]; what is not finite becomes 0."""
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.when(finite, F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))).otherwise(0.0)


def penalty(a: Column, b: Column) -> Column:
    one = lambda s: F.coalesce(*[F.when(s == k, F.lit(v)) for k, v in PENALTIES.items()], F.lit(1.0))
    return F.least(one(a), one(b))


def pair_score(strict_a: Column, strict_b: Column, jaccard: Column, shared: Column, size_a: Column, size_b: Column, cosine: Column, hours: Column, slug_a: Column, slug_b: Column) -> Column:
    """Struct (score, auto, jaccard_score, entity, primary, raw, decay, penalty) of a pair of articles."""
    auto = F.coalesce(strict_a == strict_b, F.lit(False))
    j = clip01(jaccard)
    soft = F.when(j >= SOFT_JACCARD, 0.6 + 0.4 * j).otherwise(0.5 * j)
    late = F.greatest(F.lit(0.0), hours)
    fresh = F.greatest(F.lit(0.5), 1 - late / FRESH_HOURS)
    entity = clip01(clip01(shared / F.greatest(F.lit(ENTITY_FLOOR), F.least(size_a, size_b))) * fresh)
    primary = TFIDF_WEIGHT * clip01(cosine) + ENTITY_WEIGHT * entity
    raw = clip01(F.greatest(soft, primary))
    decay = F.greatest(F.lit(0.0), 1 - late / WINDOW_HOURS)
    cost = penalty(slug_a, slug_b)
    return F.struct(
        F.when(auto, cost).otherwise(raw * decay * cost).alias("score"), auto.alias("auto"), F.when(auto, 1.0).otherwise(soft).alias("jaccard_score"), F.when(auto, 1.0).otherwise(entity).alias("entity"),
        F.when(auto, 1.0).otherwise(primary).alias("primary"), F.when(auto, 1.0).otherwise(raw).alias("raw"), F.when(auto, 1.0).otherwise(decay).alias("decay"), cost.alias("penalty"),
    )


def is_match(score: Column) -> Column:
    return F.coalesce(score >= MATCH, F.lit(False))
