"""Shards by a hierarchical weighted hash tree of regions, racks and shards.

Every shard draws -ln(u) / weight with u hashed from the document's id and the shard. A node draws what the least of its
children draws, which is distributed as one draw of its own with the sum of their weights; the descent goes to the least region, within it to
the least rack, within that to the least shard. As a node's draw changes only where a shard below it does, rows move only into a shard
whose weight grows and only out of one whose weight falls: all other racks and regions keep what they have. Shards fill
racks and regions in order, so the layout follows from their count alone, and one more shard takes rows only into itself.

Defined cases: a null id draws as one id of its own; a null text has no bytes; repeated rows, and equal texts of one id,
get the same shard and slots of their own; ties of draws go to the least node; an empty table gives no rows; texts of any length are
read once, for size and checksum; further columns of docs, whatever their names, are not looked at.
"""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed, lookup_join, repeated, table, uniform

HEADER_BYTES = 16
SHARDS_PER_RACK = 5
RACKS_PER_REGION = 4
#: Rows that one task numbers at a time.
SLOT_ROWS = 50_000

#: region -> rack -> shard -> weight
Tree = dict[int, dict[int, dict[int, float]]]


def tree(shards: int, weights: dict[int, float] | None = None) -> Tree:
    """The shards in racks and regions; weights are 1 where none is given."""
    places = [(i // (SHARDS_PER_RACK * RACKS_PER_REGION), i // SHARDS_PER_RACK, i) for i in range(shards)]
    weight = lambda i: (weights or {}).get(i, 1.0)
    return {g: {r: {i: weight(i) for *_, i in some} for r, some in groupby(inside, lambda x: x[1])} for g, inside in groupby(places, lambda x: x[0])}


def _draw(key: Column, shard: int, weight: float) -> Column:
    return F.struct((-F.ln(uniform(key, F.lit("shard"), F.lit(shard))) / weight).alias("d"), F.lit(shard).alias("n"))


def _least(draws: list[Column]) -> Column:
    return F.least(*draws) if len(draws) > 1 else draws[0]


def descent(key: Column, nodes: Tree) -> Column:
    """Draw d and number n of the shard that the descent through the tree reaches; shards without weight draw nothing."""
    racks = lambda inside: [_least(draws) for shards in inside.values() if (draws := [_draw(key, i, w) for i, w in shards.items() if w > 0])]
    return _least([_least(draws) for inside in nodes.values() if (draws := racks(inside))])


def assign(docs: DataFrame, shards: int, text: str = "text", key: str = "doc_id", weights: dict[int, float] | None = None, grown: bool = True) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and grown_shard (with one more shard of weight 1) for each row of docs.

    Slots run from 0 without gaps in each shard, ordered by a hash bucket, then by id: each bucket is numbered by
    its own task and starts where a running sum of the buckets' counts says. Equal rows are counted first and numbered as one, so that a
    bucket holds no more than different rows. Only numbers are shuffled, no texts."""
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.select(F.col(key).alias("doc_id"), (F.octet_length(t) + HEADER_BYTES).cast("long").alias("size"), F.crc32(t).alias("text_crc32"))
    df = table(df.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n")), "rows")
    found = df.agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("most")).first()
    buckets = 1 + found["rows"] // (shards * SLOT_ROWS)
    own = keyed(F.col("doc_id"))
    more = _draw(own, shards, 1.0)
    df = df.withColumn("_won", descent(own, tree(shards, weights)))
    df = df.withColumn("shard", F.col("_won.n")).withColumn("grown_shard", _least([F.col("_won"), more])["n"] if grown else F.lit(None).cast("int")).drop("_won")
    bucket = F.floor(uniform(own, F.col("text_crc32"), F.col("size"), F.lit("slot")) * buckets).cast("int")
    df = table(df.withColumn("bucket", bucket), "shards")
    counts = df.groupBy("shard", "bucket").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.concat_ws(":", "shard", "bucket").alias("place"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    numbered = df.withColumn("first", F.coalesce(F.sum("n").over(inside), F.lit(0))).withColumn("place", F.concat_ws(":", "shard", "bucket"))
    placed = lookup_join(numbered, table(offsets, "offsets"), "place")
    return repeated(placed, "n", "copy", found["most"] or 0).select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("first") + F.col("copy")).cast("long").alias("slot"), "grown_shard")
