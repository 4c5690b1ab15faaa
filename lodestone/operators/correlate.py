"""Prompts matched to metrics, scored and ranked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import blended, correlation_score, impact_score, needs_model, recommendation, score_or
from .completion import Service, message, read_reply
from .context import correlation_context
from .dedup import numbered
from .matching import top_matches, traffic_cascade

SYSTEM = "You judge how search and traffic data bear out a search query. Reply with JSON: {data_correlation_score, impact_score, recommendation, reasoning}."


def matched(prompts: DataFrame, search: DataFrame, traffic: DataFrame, threshold: float = 0.5, k: int = 10, ratio: bool = True) -> DataFrame:
    """prompts with matches (array, best first) and traffic (struct or null).

    prompts: ord, prompt_text, source_urls, …; search: ord, query, clicks, impressions, ctr, position; traffic: ord, page_path, …"""
    best = top_matches(prompts, search, threshold, k, ratio=ratio)
    fields = F.struct("match_rank", "match_score", "query", "clicks", "impressions", "ctr", "position")
    rows = best.join(search.withColumnRenamed("ord", "query_ord"), "query_ord").groupBy("prompt_ord").agg(F.array_sort(F.collect_list(fields)).alias("matches"))
    pages = traffic_cascade(prompts, traffic).join(traffic.select(F.col("ord").alias("traffic_ord"), F.struct(*(c for c in traffic.columns if c != "ord")).alias("traffic")), "traffic_ord").drop("traffic_ord")
    out = prompts.join(rows, prompts["ord"] == rows["prompt_ord"], "left").drop("prompt_ord")
    out = out.join(pages, out["ord"] == pages["prompt_ord"], "left").drop("prompt_ord")
    none = F.array().cast(dict(rows.dtypes)["matches"])
    return out.withColumn("matches", F.coalesce("matches", none))


def scored(rows: DataFrame) -> DataFrame:
    """matched() rows with data_correlation_score, impact_score and recommendation from the metrics. validation and factcheck structs may be null."""
    best, t = F.get("matches", 0), F.col("traffic")
    has, seen = F.size("matches") > 0, t.isNotNull()
    correlation = correlation_score(has, best["match_score"], best["impressions"], best["clicks"], seen, t["organic_sessions"], t["sessions"])
    impact = impact_score(F.col("relevance_score"), F.col("estimated_volume"), F.col("validation.overall_score"), F.col("factcheck.overall_factual_score"), has, best["impressions"], best["ctr"], best["position"], seen, t["organic_sessions"])
    return rows.select("*", correlation.alias("data_correlation_score"), impact.alias("impact_score"), recommendation(F.col("prompt_text"), has, best["ctr"], F.col("estimated_volume")).alias("recommendation"), F.lit("").alias("correlation_reasoning"))


def refined(rows: DataFrame, service: Service) -> DataFrame:
    """Rows with scores that matter are judged by the model, too, and blended; a failed reply keeps the metrics and loses the recommendation."""
    gate = needs_model(F.col("data_correlation_score"), F.col("impact_score"))
    asked = rows.filter(gate)
    replies = service.ask(asked, "ord", F.array(message("system", F.lit(SYSTEM)), message("user", correlation_context())), 0.3, 1024)
    replies = replies.withColumn("_r", read_reply(F.col("content"), "data_correlation_score string, impact_score string, recommendation string, reasoning string")).select("ord", "_r")
    model = lambda c: F.when(F.col(f"_r.{c}").isNotNull(), score_or(F.col(f"_r.{c}")))
    out = rows.join(replies, "ord", "left").withColumn("_gate", gate)
    text = lambda c, d: F.when(F.col("_gate"), F.coalesce(F.col(f"_r.{c}"), F.lit(""))).otherwise(d)
    new = {c: blended(F.col(c), model(c)) for c in ("data_correlation_score", "impact_score")}
    new |= {"recommendation": text("recommendation", F.col("recommendation")), "correlation_reasoning": text("reasoning", F.lit(""))}
    return out.withColumns(new).drop("_r", "_gate")


def ranked(rows: DataFrame) -> DataFrame:
    """Rows with priority_rank from 1: by impact, equal ones in order."""
    return numbered(rows, F.desc("impact_score"), "ord", name="priority_rank").withColumn("priority_rank", (F.col("priority_rank") + 1).cast("int"))


def correlate(prompts: DataFrame, search: DataFrame, traffic: DataFrame, service: Service | None = None, threshold: float = 0.5, ratio: bool = True, rank: bool = True) -> DataFrame:
    """The whole: matches, scores, model if there is one, ranks if wanted. prompts may lack validation and factcheck."""
    for name, kind in (("validation", "struct<overall_score:double,accuracy_score:double,faithfulness_score:double,quality_score:double>"), ("factcheck", "struct<overall_factual_score:double,is_factually_sound:boolean>")):
        if name not in prompts.columns:
            prompts = prompts.withColumn(name, F.lit(None).cast(kind))
    rows = scored(matched(prompts, search, traffic, threshold, ratio=ratio))
    rows = refined(rows, service) if service else rows
    return ranked(rows) if rank else rows


def best_query(field: str) -> Column:
    return F.get("matches", 0)[field]
