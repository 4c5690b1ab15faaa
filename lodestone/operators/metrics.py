"""Search and traffic metrics: roll-ups and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dedup import last_wins


def search_rollup(rows: DataFrame) -> DataFrame:
    """query, clicks, impressions, ctr, position 0 and sorted pages, from rows of query, page, clicks and impressions.

    Partial sums and their merge are the two phases of one aggregation."""
    out = rows.groupBy("query").agg(
        F.sum("clicks").cast("long").alias("clicks"),
        F.sum("impressions").cast("long").alias("impressions"),
        F.array_sort(F.collect_set("page")).alias("pages"),
    )
    ctr = F.coalesce(F.try_divide(F.col("clicks"), F.nullif(F.col("impressions"), F.lit(0))), F.lit(0.0))
    return out.select("query", "clicks", "impressions", ctr.cast("double").alias("ctr"), F.lit(0.0).alias("position"), "pages")


def merge_organic(traffic: DataFrame, organic: DataFrame) -> DataFrame:
    """traffic (one row for each page_path) with organic_sessions from organic; a path that only organic has becomes a row with other metrics 0.

    organic: ord, page_path, organic_sessions; of equal paths the last."""
    o = last_wins(organic.select("ord", "page_path", "organic_sessions"), "page_path")
    o = o.select("page_path", F.col("organic_sessions").alias("_organic"), F.col("ord").alias("_ord"))
    numbers = [c for c, t in traffic.dtypes if c not in ("ord", "page_path", "organic_sessions")]
    joined = traffic.join(o, "page_path", "full_outer")
    return joined.select(
        "page_path",
        *(F.coalesce(F.col(c), F.lit(0)).cast(dict(traffic.dtypes)[c]).alias(c) for c in numbers),
        F.coalesce("_organic", "organic_sessions").alias("organic_sessions"),
        F.coalesce(F.col("ord"), F.lit(1 << 40) + F.col("_ord")).alias("ord"),
    )


def landing_pages(pages: DataFrame, organic: DataFrame) -> DataFrame:
    """Page metrics with organic sessions; a page that only the organic report has keeps that report's row."""
    p, o = last_wins(pages, "page_path"), last_wins(organic, "page_path")
    rest = [c for c in pages.columns if c not in ("page_path", "organic_sessions", "ord")]
    joined = p.alias("p").join(o.alias("o"), "page_path", "full_outer")
    return joined.select(
        "page_path",
        *(F.coalesce(f"p.{c}", f"o.{c}").alias(c) for c in rest),
        F.coalesce("o.organic_sessions", "p.organic_sessions").alias("organic_sessions"),
        F.coalesce(F.col("p.ord"), F.lit(1 << 40) + F.col("o.ord")).alias("ord"),
    )
