"""Competitors: found by hand, by a model and by links; ordered, crawled, mined for prompts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import filled
from ..functions.urls import bare, competitor_domain, domain, manual_domain
from ..params import Extraction
from .completion import Service, message, read_reply
from .context import competitor_text, page_batches, site_summary
from .dedup import exact_dedup, numbered
from .extraction import prompts_from

DISCOVER = 'Name five to ten competitors of the site. JSON: {"target_analysis": {industry}, "competitors": [{domain, name, reason, strength, overlap_areas}]}.'
MINE = 'Find queries that this competitor ranks for and the site could win. JSON: {"prompts": [{prompt_text, relevance_score, search_intent, topic_cluster, estimated_volume, difficulty, target_coverage, competitive_gap, reasoning}]}.'
SOURCES = ("manual", "llm_discovery", "link_analysis")
STRENGTHS = ("direct", "indirect", "aspirational")


def place(c: Column, order: tuple[str, ...]) -> Column:
    """The place of a value in a fixed order; last for others."""
    out = F.lit(len(order))
    for i, value in enumerate(order):
        out = F.when(c == value, i).otherwise(out)
    return out


def linked_domains(pages: DataFrame, target: Column, limit: int = 10) -> DataFrame:
    """domain, links and first_ord of the domains that pages link to most; equal ones by first sight. pages: ord, external_links."""
    links = pages.select("ord", F.posexplode("external_links").alias("pos", "url")).withColumn("domain", domain(F.col("url")))
    rows = links.filter(competitor_domain(F.col("domain"), target))
    sums = rows.groupBy("domain").agg(F.count(F.lit(1)).alias("links"), F.min(F.struct("ord", "pos")).alias("first_seen"))
    return sums.orderBy(F.desc("links"), "first_seen").limit(limit)


def upserted(found: DataFrame) -> DataFrame:
    """One row for each domain: the first of the earliest source, but of manual rows the last. found: domain, source, ord, …"""
    rest = [c for c in found.columns if c != "domain"]
    order = F.struct(place(F.col("source"), SOURCES), F.when(F.col("source") == "manual", -F.col("ord")).otherwise(F.col("ord")))
    first = F.min(F.struct(place(F.col("source"), SOURCES).alias("s"), F.col("ord").alias("o")))
    out = found.groupBy("domain").agg(F.min_by(F.struct(*rest), order).alias("_b"), first.alias("_first"))
    return out.select("domain", *(F.col(f"_b.{c}").alias(c) for c in rest if c != "ord"), F.col("_first.o").alias("ord"))


def ordered(competitors: DataFrame, limit: int | None = None) -> DataFrame:
    """Competitors with place from 1: by source, strength, then order."""
    numbers = numbered(competitors, place(F.col("source"), SOURCES), place(F.col("strength"), STRENGTHS), "ord", name="place")
    out = numbers.withColumn("place", (F.col("place") + 1).cast("int"))
    return out.filter(F.col("place") <= limit) if limit else out


def discover(pages: DataFrame, target_url: str, manual: list[str], service: Service | None) -> DataFrame:
    """Ordered competitors of a site (schema COMPETITOR without counters)."""
    spark = pages.sparkSession
    target = F.regexp_extract(F.lit(target_url), r"//([^/?#]*)", 1)
    empty = F.array().cast("array<string>")
    typed = spark.createDataFrame(list(enumerate(manual)), "ord long, d string").select("ord", manual_domain(F.col("d")).alias("domain"))
    rows = typed.select("ord", "domain", F.col("domain").alias("name"), F.lit("Manually specified").alias("reason"), F.lit("direct").alias("strength"), empty.alias("overlap_areas"), F.lit("manual").alias("source"), F.lit(None).cast("string").alias("industry"))
    if service is not None:
        asked = site_summary(pages).withColumn("site", F.lit(0))
        said = F.concat(F.lit(f"Site: {target_url}\n\n"), F.coalesce("content", F.lit("")))
        got = service.ask(asked, "site", F.array(message("system", F.lit(DISCOVER)), message("user", said)), 0.4, 2048)
        r = read_reply(F.col("content"), "target_analysis struct<industry:string>, competitors array<struct<domain:string,name:string,reason:string,strength:string,overlap_areas:array<string>>>")
        items = got.withColumn("_r", r).select(F.col("_r.target_analysis.industry").alias("industry"), F.posexplode("_r.competitors").alias("ord", "c"))
        d = F.trim(bare(F.col("c.domain")))
        found = items.select(F.col("ord").cast("long"), d.alias("domain"), F.coalesce("c.name", d).alias("name"), F.coalesce("c.reason", F.lit("")).alias("reason"), F.coalesce("c.strength", F.lit("indirect")).alias("strength"), F.coalesce("c.overlap_areas", empty).alias("overlap_areas"), F.lit("llm_discovery").alias("source"), F.coalesce("industry", F.lit("")).alias("industry"))
        rows = rows.unionByName(found.filter(filled(F.col("domain")).isNotNull()))
    links = numbered(linked_domains(pages, target), F.desc("links"), "first_seen")
    linked = links.select(F.col("ord").cast("long"), "domain", F.col("domain").alias("name"), F.lit("Found in external links from target site").alias("reason"), F.lit("indirect").alias("strength"), empty.alias("overlap_areas"), F.lit("link_analysis").alias("source"), F.lit(None).cast("string").alias("industry"))
    return ordered(upserted(rows.unionByName(linked)))


def mine(pages: DataFrame, domain_: str, service: Service, params: Extraction = Extraction(), industry: str = "") -> DataFrame:
    """Prompts of one competitor's pages, marked with where they come from."""
    asked = page_batches(pages, params.batch, competitor_text())
    trade = f"Industry: {industry}\n" if industry else ""
    said = F.concat(F.lit(f"Competitor: {domain_}\n{trade}\n"), F.col("content"))
    replies = service.ask(asked, "batch", F.array(message("system", F.lit(MINE)), message("user", said)), 0.4, 4096).join(asked.select("batch", "urls"), "batch")
    return prompts_from(replies, "prompts", "batch", F.col("urls")).withColumn("domain", F.lit(domain_))


def counters(competitors: DataFrame, pages: DataFrame, prompts: DataFrame) -> DataFrame:
    """competitors with pages_crawled and prompts_found, 0 where there are none. pages, prompts: domain, …"""
    n = lambda df, name: df.groupBy("domain").agg(F.count(F.lit(1)).cast("int").alias(name))
    joined = competitors.join(n(pages, "pages_crawled"), "domain", "left").join(n(prompts, "prompts_found"), "domain", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("pages_crawled", "prompts_found")})


def analyse(pages: DataFrame, target_url: str, manual: list[str], service: Service, crawl: Callable[[list[str]], DataFrame], limit: int = 5, params: Extraction = Extraction()) -> tuple[DataFrame, DataFrame]:
    """Competitors with counters, and their distinct prompts. crawl gives the pages (site, …) of all domains at once; limit competitors are crawled."""
    chosen = discover(pages, target_url, manual, service).filter(F.col("place") <= limit).persist()
    rows = chosen.select("domain", "place", "industry").orderBy("place").collect()  # limit rows
    if not rows:
        none = chosen.select("domain").limit(0)
        return counters(chosen, none, none), None
    industry = next((r["industry"] for r in rows if r["industry"]), "")
    pages_ = service.store(crawl([r["domain"] for r in rows]))
    all_prompts = None
    for row in rows:
        site = pages_.filter(F.col("site") == row["domain"]).drop("site")
        found = mine(site, row["domain"], service, params, industry).withColumn("_place", F.lit(row["place"]))
        all_prompts = found if all_prompts is None else all_prompts.unionByName(found)
    # in the order of the competitors, so that of equal texts the row of the first of them stays
    unique = exact_dedup(numbered(all_prompts, "_place", "_order", "_pos").drop("_place", "_order", "_pos", "domain"))
    return counters(chosen, pages_.select(F.col("site").alias("domain")), all_prompts), unique
