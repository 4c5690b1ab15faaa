"""Lookups by text, page or place, and status transitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .dedup import last_wins


def passing(validations: DataFrame, min_quality: float = 0.7) -> DataFrame:
    """Validations that reach the overall score and are not rated rejected, best first."""
    good = (F.col("overall_score") >= min_quality) & (F.col("quality_rating") != "rejected")
    return validations.filter(good).orderBy(F.desc("overall_score"), "ord")


def with_status(prompts: DataFrame, validations: DataFrame, min_quality: float = 0.7) -> DataFrame:
    """prompts with status validated if a passing validation has their exact text, else rejected."""
    texts = passing(validations, min_quality).select("prompt_text").distinct().withColumn("_ok", F.lit(True))
    joined = prompts.join(texts, "prompt_text", "left")
    return joined.withColumn("status", F.when(F.col("_ok"), "validated").otherwise("rejected")).drop("_ok")


def skipped_validation(prompts: DataFrame) -> DataFrame:
    return prompts.withColumn("status", F.lit("validated"))


def factchecked(prompts: DataFrame, results: DataFrame | None) -> DataFrame:
    """Validated prompts whose check found them sound become factchecked; without results all validated ones do.

    results: ord (that of the prompt), is_factually_sound."""
    if results is None:
        return prompts.withColumn("status", F.when(F.col("status") == "validated", "factchecked").otherwise(F.col("status")))
    flags = results.select("ord", F.col("is_factually_sound").alias("_sound"))
    status = F.when((F.col("status") == "validated") & F.coalesce("_sound", F.lit(False)), "factchecked").otherwise(F.col("status"))
    return prompts.join(flags, "ord", "left").withColumn("status", status).drop("_sound")


def active(prompts: DataFrame) -> DataFrame:
    """Validated and factchecked prompts; all, if there are none."""
    flag = F.col("status").isin("factchecked", "validated")
    any_ = prompts.agg(F.max(flag.cast("int")).alias("_any"))
    return prompts.join(F.broadcast(any_), flag | (F.coalesce("_any", F.lit(0)) == 0)).drop("_any")


def with_results(prompts: DataFrame, results: DataFrame, name: str) -> DataFrame:
    """prompts with a struct column name: the last of results with their exact text, or null."""
    last = last_wins(results, "prompt_text")
    fields = F.struct(*(c for c in last.columns if c not in ("prompt_text", "ord")))
    return prompts.join(last.select("prompt_text", fields.alias(name)), "prompt_text", "left")


def page_context(prompts: DataFrame, pages: DataFrame, limit: int = 3) -> DataFrame:
    """prompt_ord, page_ord, place: the first limit pages that a prompt names; for prompts without one, the first pages of all."""
    named = prompts.select(F.col("ord").alias("prompt_ord"), F.explode(F.array_distinct("source_urls")).alias("url"))
    p = pages.select(F.col("ord").alias("page_ord"), "url")
    place = lambda c: F.row_number().over(Window.partitionBy(c).orderBy("page_ord"))
    # a prompt's first pages are among the first ones of its URLs, so no more of a URL meet its prompts
    firsts = p.withColumn("place", place("url")).filter(F.col("place") <= limit).drop("place")
    found = named.join(firsts, "url").withColumn("place", place("prompt_ord")).filter(F.col("place") <= limit)
    first = p.orderBy("page_ord").limit(limit).withColumn("place", F.row_number().over(Window.orderBy("page_ord")))
    without = prompts.select(F.col("ord").alias("prompt_ord")).join(found.select("prompt_ord").distinct(), "prompt_ord", "left_anti")
    fallback = without.join(F.broadcast(first), F.lit(True))  # limit rows
    return found.select("prompt_ord", "page_ord", "place").unionByName(fallback.select("prompt_ord", "page_ord", "place"))


def by_place(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
    """left with the row of right at the same place (ord), as a struct column name."""
    return left.join(right.select("ord", F.struct(*(c for c in right.columns if c != "ord")).alias(name)), "ord", "left")
