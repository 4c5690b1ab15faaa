"""Exact deduplication, last-wins keys and merges of prompt relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import filled, key, trimmed
from ..storage import stored


def exact_dedup(prompts: DataFrame, text: str = "prompt_text", score: str = "relevance_score", urls: str = "source_urls", by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each lower-cased, trimmed text (and value of by): the first row's columns, the best score, all URLs sorted."""
    rest = [c for c in prompts.columns if c not in (score, urls, *by)]
    aggs = [F.min_by(F.struct(*rest), "ord").alias("_first"), F.max(score).alias(score)]
    if urls in prompts.columns:
        aggs.append(F.array_sort(F.array_distinct(F.flatten(F.collect_set(urls)))).alias(urls))
    out = prompts.groupBy(*by, key(F.col(text)).alias("_key")).agg(*aggs)
    return out.select(*(F.col(f"_first.{c}").alias(c) if c in rest else F.col(c) for c in prompts.columns))


def distinct_texts(df: DataFrame, text: str, order: str) -> DataFrame:
    """text_key, the first row's order, and how many rows share the key."""
    return df.groupBy(key(F.col(text)).alias("text_key")).agg(F.min(order).alias("first_ord"), F.count(F.lit(1)).alias("copies"))


def last_wins(df: DataFrame, *keys: str) -> DataFrame:
    """The last row of each key, in the place of the first."""
    rest = [c for c in df.columns if c not in (*keys, "ord")]
    out = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "ord").alias("_last"), F.min("ord").alias("ord"))
    return out.select(*(F.col(f"_last.{c}").alias(c) if c in rest else F.col(c) for c in df.columns))


def merge_new(mine: DataFrame, theirs: DataFrame, text: str = "prompt_text") -> DataFrame:
    """mine, and after it the rows of theirs whose text it lacks; duplicates within theirs stay."""
    seen = mine.select(key(F.col(text)).alias("_key")).distinct()
    new = theirs.withColumn("_key", key(F.col(text))).join(seen, "_key", "left_anti").drop("_key")
    return mine.withColumn("part", F.lit(0)).unionByName(new.withColumn("part", F.lit(1)), allowMissingColumns=True)


#: Bits of a row's number within its partition, as monotonically_increasing_id() gives them.
WITHIN = 33


def numbered(df: DataFrame, *order: Column | str, name: str = "ord") -> DataFrame:
    """Rows numbered from 0 in a total order.

    A sort deals the rows to ranges, a table keeps them, and each row's number is its place in its range plus the rows of the ranges
    before. What is summed in one task is a row for each range, never the rows themselves."""
    rest = [c for c in df.columns if c != name]
    held = stored(df.orderBy(*order).select(*rest, F.monotonically_increasing_id().alias("_at")), "numbered")
    held = held.withColumn("_range", F.shiftright("_at", WITHIN))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = held.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    number = F.col("_start") + F.col("_at").bitwiseAND((1 << WITHIN) - 1)
    return held.join(F.broadcast(starts), "_range").select(*rest, number.cast("long").alias(name))


def batches(df: DataFrame, size: int, name: str = "batch") -> DataFrame:
    """The number of each row's batch of size rows, by ord."""
    return numbered(df, "ord", name="_place").withColumn(name, F.floor(F.col("_place") / size).cast("long")).drop("_place")


def top(df: DataFrame, score: str, n: int) -> DataFrame:
    """The n rows of the highest score; of equal ones the first."""
    return df.orderBy(F.desc(score), "ord").limit(n)


def non_empty(df: DataFrame, text: str = "prompt_text") -> DataFrame:
    return df.filter(filled(trimmed(F.col(text))).isNotNull())
