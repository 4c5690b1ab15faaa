"""Connected components of a graph of any size, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, lookup_join, table


def _with_least(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges with m, the least of u's neighbours and u; and the table that holds it."""
    least = table(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    return lookup_join(edges, least, "u", "inner"), least


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """id and root (the least id of its component) of every node that an edge (a, b) names.

    Rounds of large and small stars: each node hands its larger neighbours, then its smaller ones, to the least node
    that it knows, until nothing changes. A node's least neighbour is summed up before the shuffle, and neighbours are
    never gathered: a table of least neighbours of checked size is broadcast, a larger one joined with salted nodes, so that
    a hub's edges meet in no single task."""
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    now = table(pairs, "edges")
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        joined, least = _with_least(both)
        large = table(joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        drop_table(least)
        joined, least = _with_least(large)
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        after = table(small.filter("u <> v").distinct(), "edges")
        for old in (least, large, now):
            drop_table(old)
        now = after
        before, state = state, now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
    roots = now.select(F.col("v").alias("id")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots.select("id", F.col("id").alias("root")))
