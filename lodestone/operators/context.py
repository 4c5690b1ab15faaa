"""Texts that are assembled for model calls, with their caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import capped, filled, labelled, listed
from ..storage import stored
from .dedup import batches


def page_text(body: int, h1: int | None, h2: int | None, h3: int | None, url: str = "URL: ", meta: str = "Meta: ", count: bool = False) -> Column:
    """A page as lines: URL, title, description, headings and body, each cut to its cap; caps of None leave lines out."""
    every = 1 << 30
    lines = [F.concat(F.lit(url), F.col("url")), labelled("Title: ", F.col("title")), labelled(meta, F.col("meta_description"))]
    for name, cap in (("h1", h1), ("h2", h2), ("h3", h3)):
        if cap is not None:
            lines.append(listed(f"{name.upper()}: ", F.col(f"{name}_tags"), cap or every))
    lines.append(labelled("Content: ", F.substring(F.coalesce("body_text", F.lit("")), 1, body)))
    if count:
        lines.append(F.concat(F.lit("Words: "), F.col("word_count").cast("string")))
    return F.concat_ws("\n", *lines)


def extraction_text() -> Column:
    return page_text(3000, 0, 10, 10, count=True)


def debate_text() -> Column:
    return page_text(1500, 0, 5, None)


def factcheck_text() -> Column:
    return page_text(2000, 0, 8, None)


def competitor_text() -> Column:
    return page_text(1500, 3, 5, None)


def summary_text() -> Column:
    return page_text(200, 3, None, None, url="Page: ", meta="Description: ")


def in_order(value: Column, order: Column | str, sep: str) -> Column:
    """Texts of a group joined in order."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order) if isinstance(order, str) else order, value.alias("_v"))))
    return F.array_join(F.transform(pairs, lambda x: x["_v"]), sep)


def page_batches(pages: DataFrame, size: int = 10, text: Column | None = None) -> DataFrame:
    """batch, content and urls of each batch of pages."""
    rows = batches(pages, size).withColumn("_text", extraction_text() if text is None else text)
    numbered = F.transform(F.array_sort(F.collect_list(F.struct("ord", "_text"))), lambda x, i: F.concat(F.lit("=== PAGE "), (i + 1).cast("string"), F.lit(" ===\n"), x["_text"]))
    urls = F.transform(F.array_sort(F.collect_list(F.struct("ord", "url"))), lambda x: x["url"])
    return rows.groupBy("batch").agg(F.array_join(numbered, "\n\n").alias("content"), urls.alias("urls"))


def site_lines(pages: DataFrame, limit: int = 50) -> DataFrame:
    """One row: a line for each of the first pages, the description cut to 100 characters."""
    first = pages.orderBy("ord").limit(limit)
    line = F.concat_ws(" | ", F.concat(F.lit("- "), F.col("url")), filled(F.col("title")), filled(F.substring("meta_description", 1, 100)))
    return first.agg(in_order(line, "ord", "\n").alias("content"))


def site_summary(pages: DataFrame, considered: int = 20, kept: int = 15) -> DataFrame:
    """One row: the summaries of the first kept of the first considered pages."""
    first = pages.orderBy("ord").limit(considered).orderBy("ord").limit(kept)
    return first.agg(in_order(summary_text(), "ord", "\n\n").alias("content"))


def prompt_pages(context: DataFrame, pages: DataFrame, text: Column) -> DataFrame:
    """prompt_ord and the texts of its pages (context: prompt_ord, page_ord, place).

    Each list of pages gets its text once, however many prompts share it, so that no page's prompts meet in one task."""
    places = F.transform(F.array_sort(F.collect_list(F.struct("place", "page_ord"))), lambda x: x["page_ord"])
    lists = stored(context.groupBy("prompt_ord").agg(places.alias("_list")), "lists")
    each = lists.select("_list").distinct().select("_list", F.posexplode("_list").alias("_place", "page_ord"))
    texts = each.join(pages.withColumn("_text", text).select(F.col("ord").alias("page_ord"), "_text"), "page_ord")
    return lists.join(texts.groupBy("_list").agg(in_order(F.col("_text"), "_place", "\n\n---\n\n").alias("content")), "_list").select("prompt_ord", "content")


def consolidation_payload() -> Column:
    """Six fields of a prompt, three of its URLs, as JSON."""
    return F.to_json(F.struct("prompt_text", "relevance_score", "search_intent", "topic_cluster", "estimated_volume", F.slice("source_urls", 1, 3).alias("source_urls")))


def claims_payload(claims: Column, first_round: bool | None) -> Column:
    """Claims as JSON. first_round None: for rewording; True or False: for verification, False with the verdict so far."""
    if first_round is None:
        return F.to_json(F.transform(claims, lambda c: F.struct(c["claim_text"].alias("claim_text"), c["source_context"].alias("source_context"))))
    so_far = lambda c: F.lit("pending") if first_round else c["verification_status"]
    return F.to_json(F.transform(claims, lambda c: F.struct(c["claim_text"].alias("claim_text"), c["is_verifiable"].alias("is_verifiable"), so_far(c).alias("previous_verdict"))))


def verdicts_payload(claims: Column) -> Column:
    return F.to_json(F.transform(claims, lambda c: F.struct(F.substring(c["claim_text"], 1, 100).alias("claim"), c["verification_status"].alias("verdict"), c["confidence"].alias("confidence"))))


def correlation_context() -> Column:
    """The lines that a correlation request is made of; columns of operators.correlate.matched()."""
    number = lambda f, c: F.format_string(f, F.col(c) if isinstance(c, str) else c)
    queries = F.transform(
        F.slice("matches", 1, 5),
        lambda m: F.concat(F.lit('  - "'), m["query"], F.lit('" (match: '), F.format_string("%.2f", m["match_score"]), F.lit(") - Clicks: "), m["clicks"].cast("string"), F.lit(", Impressions: "), m["impressions"].cast("string"), F.lit(", CTR: "), F.format_string("%.3f", m["ctr"]), F.lit(", Position: "), F.format_string("%.1f", m["position"])),
    )
    search = F.when(F.size("matches") > 0, F.concat(F.lit("Matching queries:\n"), F.array_join(queries, "\n"))).otherwise("Search data: No matching queries found")
    traffic = F.when(F.col("traffic").isNotNull(), F.concat(F.lit("Traffic: Sessions: "), F.col("traffic.sessions").cast("string"), F.lit(", Organic: "), F.col("traffic.organic_sessions").cast("string"), F.lit(", Pageviews: "), F.col("traffic.pageviews").cast("string"), F.lit(", Bounce Rate: "), number("%.2f", "traffic.bounce_rate"))).otherwise("Traffic: No matching page data found")
    checked = F.when(F.col("validation").isNotNull(), F.concat(F.lit("Validation Score: "), number("%.2f", "validation.overall_score")))
    sound = F.when(F.col("factcheck").isNotNull(), F.concat(F.lit("Factcheck Score: "), number("%.2f", "factcheck.overall_factual_score")))
    head = [F.concat(F.lit('Search Prompt: "'), F.col("prompt_text"), F.lit('"'))]
    head += [F.concat(F.lit(f"{name}: "), F.coalesce(F.col(c), F.lit(""))) for name, c in (("Search Intent", "search_intent"), ("Topic", "topic_cluster"), ("Estimated Volume", "estimated_volume"), ("Difficulty", "difficulty"))]
    return F.concat_ws("\n", *head, checked, sound, search, traffic)


def truncated(c: Column, limit: int = 800) -> Column:
    return capped(c, limit)
