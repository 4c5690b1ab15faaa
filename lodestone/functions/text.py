"""Text columns: keys, normal forms, word sets. White space is Unicode's, as \\s with (?U)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def key(c: Column) -> Column:
    """Lower case, trimmed."""
    return F.lower(trimmed(c))


def normal(c: Column) -> Column:
    """key() with runs of white space as one space."""
    return F.regexp_replace(key(c), r"(?U)\s+", " ")


def words(normalised: Column) -> Column:
    """Distinct words of a normal() text."""
    return F.array_remove(F.array_distinct(F.split(normalised, " ")), "")


def word_overlap(a: Column, b: Column) -> Column:
    """Common words over the larger number of words; 0 if either has none. a, b: words()."""
    most = F.greatest(F.size(a), F.size(b))
    none = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(none, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / most)


def either_contains(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def filled(c: Column) -> Column:
    """The text, or null if it is empty."""
    return F.nullif(c, F.lit(""))


def word_count(c: Column) -> Column:
    t = trimmed(F.coalesce(c, F.lit("")))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"(?U)\s+")))


def capped(c: Column, limit: int, mark: str = "...") -> Column:
    """The text, cut to limit characters and marked if it is longer."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(mark))).otherwise(c)


def labelled(label: str, c: Column) -> Column:
    """label and the text, or null if the text is missing or empty."""
    return F.concat(F.lit(label), filled(c))


def listed(label: str, c: Column, limit: int, sep: str = ", ") -> Column:
    """label and the first limit members of an array, or null if it is empty."""
    return F.when(F.size(c) > 0, F.concat(F.lit(label), F.array_join(F.slice(c, 1, limit), sep)))


def file_key(domain: Column) -> Column:
    return F.translate(domain, "./", "__")
