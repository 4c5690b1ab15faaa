"""Scores, tiers and coercions. Sums keep the order of their terms, so that doubles agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import trimmed


def number(c: Column) -> Column:
    """A number as exports write it: commas, percent and dollar signs go; what is none is 0."""
    t = F.regexp_replace(trimmed(c), "[,%$]", "")
    valid = t.rlike(r"^(?U)\s*[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+)?\s*$")
    value = F.when(valid, F.regexp_replace(trimmed(t), "_", "").cast("double"))
    return F.coalesce(value, F.lit(0.0))


def whole(c: Column) -> Column:
    """number(), cut towards zero."""
    return number(c).cast("long")


def percent(c: Column) -> Column:
    """number(); above 1 it is taken for a percentage."""
    n = number(c)
    return F.when(n > 1, n / 100.0).otherwise(n)


def correlation_score(matched: Column, match_score: Column, impressions: Column, clicks: Column, has_traffic: Column, organic: Column, sessions: Column) -> Column:
    """How far search and traffic metrics bear a prompt out; 1 at most."""
    some = lambda c, x: F.when(c, F.lit(x)).otherwise(F.lit(0.0))
    search = F.when(matched, match_score * 0.3 + some(impressions > 0, 0.15) + some(clicks > 0, 0.15)).otherwise(F.lit(0.0))
    traffic = F.when(has_traffic, F.lit(0.2)).otherwise(F.lit(0.0))
    traffic_organic = some(F.coalesce(has_traffic & (organic > 0), F.lit(False)), 0.1)
    traffic_busy = some(F.coalesce(has_traffic & (sessions > 10), F.lit(False)), 0.1)
    return F.least(search + traffic + traffic_organic + traffic_busy, F.lit(1.0))


def impact_score(relevance: Column, volume: Column, validation: Column, factcheck: Column, matched: Column, impressions: Column, ctr: Column, position: Column, has_traffic: Column, organic: Column) -> Column:
    """Weighted relevance, validation, search opportunity and traffic over the weights in use; 1 at most. Null validation or factcheck are out of use."""
    tier = F.when((impressions > 100) & (ctr < 0.05), 0.3).when((impressions > 50) & (ctr < 0.1), 0.2).when(impressions > 10, 0.1).otherwise(0.0)
    place = F.when(position > 10, 0.1).when(position > 3, 0.05).otherwise(0.0)
    unmatched = F.when(volume.isin("high", "medium"), 0.15).otherwise(0.0)
    busy = F.when(organic > 100, 0.2).when(organic > 50, 0.15).when(organic > 10, 0.1).otherwise(0.05)
    guess = F.when(volume == "high", 0.15).when(volume == "medium", 0.1).otherwise(0.05)
    score = F.coalesce(validation * 0.2, F.lit(0.0)) + F.coalesce(factcheck * 0.15, F.lit(0.0)) + relevance * 0.15
    score = score + F.when(matched, tier).otherwise(unmatched) + F.when(matched, place).otherwise(0.0)
    score = score + F.when(has_traffic, busy).otherwise(guess)
    used = F.when(validation.isNotNull(), 0.2).otherwise(0.0) + F.when(factcheck.isNotNull(), 0.15).otherwise(0.0) + F.lit(0.15) + F.lit(0.3) + F.lit(0.2)
    return F.least(score / used, F.lit(1.0))


def recommendation(prompt: Column, matched: Column, ctr: Column, volume: Column) -> Column:
    """What to do about a prompt, from its metrics alone."""
    quoted = F.concat(F.lit("'"), prompt, F.lit("'"))
    seen = F.concat(F.lit("Optimize meta title/description for "), quoted, F.lit(" - high impressions but low CTR"))
    gap = F.concat(F.lit("Create/optimize content targeting "), quoted, F.lit(" - potential content gap"))
    watch = F.concat(F.lit("Monitor performance for "), quoted)
    return F.when(matched & (ctr < 0.05), seen).when(~matched & volume.isin("high", "medium"), gap).otherwise(watch)


def needs_model(correlation: Column, impact: Column) -> Column:
    return (correlation > 0.3) | (impact > 0.5)


def blended(metric: Column, model: Column) -> Column:
    """Four tenths of the metric and six of the model's score, where there is one."""
    return F.when(model.isNotNull(), metric * 0.4 + model * 0.6).otherwise(metric)


def boosted(score: Column, boost: Column) -> Column:
    return F.least(F.lit(1.0), score + boost)


def impact_tier(impact: Column) -> Column:
    return F.when(impact >= 0.7, "high").when(impact >= 0.4, "medium").otherwise("low")


def drift_tier(drift: Column) -> Column:
    return F.when(drift < 0.2, "LOW").when(drift < 0.5, "MODERATE").otherwise("HIGH")


def high_impact(impact: Column, correlation: Column, min_impact: float = 0.5, min_correlation: float = 0.3) -> Column:
    return (impact >= min_impact) | (correlation >= min_correlation)


def rating(c: Column) -> Column:
    t = F.lower(c)
    return F.when(t.isin("high", "medium", "low", "rejected"), t).otherwise("medium")


def score_or(c: Column, default: float = 0.5) -> Column:
    """A model's score, given as text, as a double: default if it is absent, null if it is no number."""
    return F.when(c.isNull(), F.lit(default)).otherwise(c.try_cast("double"))


def verdict_default(flag: Column, score: Column) -> Column:
    """A missing verdict is true if the score reaches 0.6."""
    return F.coalesce(flag, score >= 0.6)
