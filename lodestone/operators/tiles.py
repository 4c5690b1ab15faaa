"""Two relations compared group by group, in tiles of bounded size.

Each group's left rows are dealt to tiles and its right rows to blocks by hash; a task gets one tile and one block at a time. So every left row
meets every right row of its group once, no task holds more than a tile and a block, and no group, however large, meets in
one task. What a task gives for a left row should be few rows.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Left rows of a tile and right rows of a block, about.
TILE, BLOCK = 1024, 32_768


def group_key(c: Column) -> Column:
    """A key that keeps null apart from every text."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))


def tiled(left: DataFrame, right: DataFrame, group: str, one: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """one(left, right) of every tile and block of a group, which both sides have. left and right are stored: they are read twice."""
    right = right.select(*(F.col(c).alias(c) for c in right.columns))  # columns of its own, if both are made from one table
    n = lambda df, size, name: df.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias(name))
    sizes = n(left, TILE, "_tiles").join(n(right, BLOCK, "_blocks"), group)
    dealt = lambda df, c, own, other: (
        df.join(sizes, group)
        .withColumn(own, F.pmod(F.xxhash64(c), F.col(f"{own}s")).cast("int"))
        .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)))
        .drop("_tiles", "_blocks")
    )
    keys = [group, "_tile", "_block"]
    lefts = dealt(left, "a", "_tile", "_block").groupBy(*keys)
    return lefts.cogroup(dealt(right, "b", "_block", "_tile").groupBy(*keys)).applyInPandas(one, schema)
