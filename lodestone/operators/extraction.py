"""Prompt extraction by a model: page batches, the site as a whole, consolidation of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import score_or
from ..functions.text import key
from ..params import Extraction
from .completion import Service, message, read_reply
from .context import consolidation_payload, in_order, page_batches, site_lines
from .dedup import batches, exact_dedup, numbered, top

ITEM = (
    "struct<prompt_text:string,relevance_score:string,search_intent:string,topic_cluster:string,estimated_volume:string,difficulty:string,"
    "reasoning:string,content_match_score:string,source_urls:array<string>,target_coverage:string,competitive_gap:string>"
)
REPLY = f"prompts array<{ITEM}>, items array<{ITEM}>, additional_prompts array<{ITEM}>"
EXTRACT = "You find the search queries that a web page answers. Reply with JSON: {\"prompts\": [{prompt_text, relevance_score, search_intent, topic_cluster, estimated_volume, difficulty, reasoning}]}."
SITE = "You find search queries that a site as a whole could answer. Reply with JSON: {\"site_analysis\": {}, \"additional_prompts\": [...]}."
CONSOLIDATE = "You merge search queries that mean the same and score the rest. Reply with JSON: {\"prompts\": [{prompt_text, relevance_score, content_match_score, source_urls, ...}]}."


def prompts_from(replies: DataFrame, list_: str, order: str, urls: Column | None) -> DataFrame:
    """Prompts of the replies (content and order) in the list's order. A reply with a score that is no number gives none at all; rows without text go.

    urls: the URLs that each prompt of a reply gets, null for those the reply names."""
    items = F.coalesce(F.col("_r")[list_], F.col("_r")["items"])
    read = replies.withColumn("_r", read_reply(F.col("content"), REPLY)).withColumn("_items", items)
    bad = F.exists("_items", lambda x: score_or(x["relevance_score"]).isNull())
    rows = read.filter(~F.coalesce(bad, F.lit(True))).select("*", F.posexplode("_items").alias("_pos", "_x"))
    x = F.col("_x")
    either = lambda c, d: F.coalesce(x[c], F.lit(d))
    out = rows.filter(F.length(F.trim(F.coalesce(x["prompt_text"], F.lit("")))) > 0).select(
        F.col(order).alias("_order"), "_pos",
        F.trim(x["prompt_text"]).alias("prompt_text"),
        (F.coalesce(x["source_urls"], F.array().cast("array<string>")) if urls is None else urls).alias("source_urls"),
        score_or(x["relevance_score"]).alias("relevance_score"),
        either("search_intent", "informational").alias("search_intent"),
        either("topic_cluster", "").alias("topic_cluster"),
        either("estimated_volume", "medium").alias("estimated_volume"),
        either("difficulty", "medium").alias("difficulty"),
        F.coalesce(score_or(x["content_match_score"], 0.0), F.lit(0.0)).alias("content_match_score"),
        F.lit("extracted").alias("status"),
        either("reasoning", "").alias("extraction_reasoning"),
    )
    return out


def extract_batches(pages: DataFrame, service: Service, params: Extraction = Extraction()) -> DataFrame:
    asked = page_batches(pages, params.batch)
    messages = F.array(message("system", F.lit(EXTRACT)), message("user", F.col("content")))
    replies = service.ask(asked, "batch", messages, 0.4, 4096).join(asked.select("batch", "urls"), "batch")
    return prompts_from(replies, "prompts", "batch", F.col("urls"))


def extract_site(pages: DataFrame, service: Service) -> DataFrame:
    asked = site_lines(pages).withColumn("site", F.lit(0))
    messages = F.array(message("system", F.lit(SITE)), message("user", F.col("content")))
    return prompts_from(service.ask(asked, "site", messages, 0.5, 4096), "additional_prompts", "site", F.array().cast("array<string>"))


def consolidate(prompts: DataFrame, service: Service, params: Extraction = Extraction()) -> DataFrame:
    """Chunks of prompts merged by the model; a chunk whose reply fails stays as it is."""
    chunks = batches(prompts, params.chunk, "chunk")
    asked = chunks.withColumn("_json", consolidation_payload()).groupBy("chunk").agg(F.concat(F.lit("["), in_order(F.col("_json"), "ord", ","), F.lit("]")).alias("content"))
    messages = F.array(message("system", F.lit(CONSOLIDATE)), message("user", F.col("content")))
    replies = service.ask(asked, "chunk", messages, 0.3, 4096)
    merged = prompts_from(replies, "prompts", "chunk", None)
    failed = chunks.join(merged.select(F.col("_order").alias("chunk")).distinct(), "chunk", "left_anti")
    kept = failed.select(F.col("chunk").alias("_order"), F.col("ord").cast("int").alias("_pos"), *(c for c in merged.columns if c not in ("_order", "_pos")))
    return merged.unionByName(kept)


def extract(pages: DataFrame, service: Service, params: Extraction = Extraction()) -> DataFrame:
    """Prompts of a site: batches and the whole, made distinct, consolidated in their order if there are more than twice the wanted number, best first, equal ones as they came."""
    both = extract_batches(pages, service, params).withColumn("_part", F.lit(0)).unionByName(extract_site(pages, service).withColumn("_part", F.lit(1)))
    order = lambda df, *first: numbered(df, *first, "_order", "_pos").drop("_part", "_order", "_pos")
    unique = exact_dedup(order(both, "_part"))
    if unique.count() > 2 * params.top_n:
        unique = order(consolidate(numbered(unique, "ord"), service, params))
    best = top(unique.filter(F.length(key(F.col("prompt_text"))) > 0), "relevance_score", params.top_n)
    return numbered(best, F.desc("relevance_score"), "ord")
