"""Date ranges of requests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def date_range(end: Column, days: int) -> Column:
    """start and end (yyyy-MM-dd) of the days before end."""
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    return F.struct(text(F.date_sub(end, days)).alias("start"), text(end).alias("end"))
