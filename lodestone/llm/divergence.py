"""How far the sources of a language differ in their use of its words.

Terms are exploded from the texts and counted by group (language and source). Groups are crossed with the kept vocabulary of
their language, so that a term that a group lacks has a count of zero there. Shares are smoothed whole numbers of parts of
SCALE. The dense table is joined with itself on language and term, differences are summed for each pair of sources, and
windows rank them. All arithmetic is in whole numbers.

Crossing and pairing are joins on language and on language and term: a result for every pair of sources of a language is
what is asked for, and terms are summed up before the shuffle, a row a pair and task.

Defined cases: a null text, language or source is an empty one; each row counts as a document; a group without terms counts all kept
terms zero times; a language without kept terms has pairs of value 0 and no terms; ties of value go by the bytes of the
item; texts of any length are read whole; an empty table gives no rows; only the three columns are read, whatever docs has
besides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, table

#: Letters A to Z and all code points beyond ASCII; written as what a term holds, as a complement of ranges takes ten times as long to match.
TERM = r"[A-Za-z\x80-\x{10FFFF}]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Documents of the language that a kept term is in, parts of a share, what is added to each count, ranks of terms.
DOCS, SCALE, PRIOR, TOP = 30, 1_000_000_000, 5, 50
#: Parts in which a language's vocabulary meets its groups where these are too many to broadcast.
SALTS = 64


def _whole(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents that hold it)."""
    terms = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))
    sorted_ = _whole(docs).select("lang", "source", F.sort_array(terms).alias("_terms"))
    first = lambda x, i: (F.coalesce(F.get("_terms", i - 1) != x, F.lit(True))).cast("int")
    each = sorted_.select("lang", "source", F.inline(F.transform("_terms", lambda x, i: F.struct(x.alias("term"), first(x, i).alias("first")))))
    return each.groupBy("lang", "source", "term").agg(F.count(F.lit(1)).alias("n"), F.sum("first").alias("docs"))


def _share(count: Column, total: Column, v: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * v)), exact."""
    wide = lambda c: c.cast("decimal(20,0)")
    # remainders of positive whole numbers are exact, and so is the quotient of what is left without one
    top, bottom = wide(count + PRIOR) * F.lit(SCALE).cast("decimal(10,0)"), wide(total + PRIOR * v)
    return F.lit(1) + F.call_function("div", top, bottom)


def shares(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables of the groups (lang, source) and of lang, source, term, count, p, q for every group and kept term of its language; q is the language's share."""
    counts = table(term_counts(docs), "term-counts")
    groups = table(_whole(docs).select("lang", "source").distinct(), "groups")
    kept = table(counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_count"), F.sum("docs").alias("docs")).filter(F.col("docs") >= DOCS).drop("docs"), "vocabulary")
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_count").alias("lang_total"))
    known = counts.join(kept.select("lang", "term"), ["lang", "term"], "left_semi").select("lang", "source", "term", F.col("n").alias("count"))
    totals = known.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    places = table(groups.join(sizes, "lang").join(totals, ["lang", "source"], "left").withColumn("total", F.coalesce("total", F.lit(0))), "group-totals")
    if small(places):
        crossed = kept.join(F.broadcast(places), "lang")
    else:
        salted = places.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        crossed = kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "salt"]).drop("salt")
    dense = crossed.join(known, ["lang", "source", "term"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    p, q = _share(F.col("count"), F.col("total"), F.col("v")), _share(F.col("lang_count"), F.col("lang_total"), F.col("v"))
    return groups, table(dense.select("lang", "source", "term", "count", p.alias("p"), q.alias("q")), "shares")


def _ranked(df: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    return df.withColumn("rank", F.row_number().over(order))


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: part pair has the other sources of the language by distance, part term the terms that the group uses more than its language."""
    groups, dense = shares(docs)
    one = dense.select("lang", "term", "source", "p")
    other = dense.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("p2"))
    # each pair once; its distance is the same from both sides
    half = one.join(other, ["lang", "term"]).filter(F.col("source") < F.col("item"))
    sums = table(half.groupBy("lang", "source", "item").agg(F.sum(F.abs(F.col("p") - F.col("p2"))).alias("value")), "distances")
    both = sums.unionByName(sums.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    pairs = groups.join(groups.select("lang", F.col("source").alias("item")), "lang").filter(F.col("source") != F.col("item"))
    pairs = pairs.join(both, ["lang", "source", "item"], "left").withColumn("value", F.coalesce("value", F.lit(0)))
    terms = dense.filter("count > 0 AND p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    out = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
    return out(_ranked(pairs), "pair").unionByName(out(_ranked(terms).filter(F.col("rank") <= TOP), "term"))
