"""Mixing sources to target weights by Poisson replication.

Each source's mass (bytes of text) and its target share give a mean repetition rate. A document's
count is the Poisson quantile, for that mean, of a uniform number hashed from its id and
a seed; it is repeated so often, and all copies are dealt to partitions and sorted by a hash.

Defined cases: a null source is a source of its own; a null or empty text has mass 0 and
still a rate (a source without mass gets rate 0); rows whose id is null or occurs again draw each for
themselves, by a hash of the row and a number among equal rows, and are dealt apart; ties of the hash keep any order; an empty table gives no rows; texts
of any length travel whole; other columns of docs, whatever their names, stay in row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import digits, keyed, lookup_join, repeated, table, uniform

#: Larger means are sums of draws whose means are at most this, so that exp(-mean) keeps its digits.
PART_MEAN = 30.0


def poisson(u: Column, mean: Column) -> Column:
    """The least k for which the Poisson distribution function with this mean (PART_MEAN at most) reaches u."""
    steps = F.sequence(F.lit(1), F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int"))
    start = F.struct(F.lit(0).alias("k"), F.exp(-mean).alias("p"), F.exp(-mean).alias("c"))

    def step(a: Column, k: Column) -> Column:
        p = a["p"] * mean / k
        return F.when(a["c"] < u, F.struct(k.alias("k"), p.alias("p"), (a["c"] + p).alias("c"))).otherwise(a)

    return F.aggregate(steps, start, step, lambda a: a["k"])


def counts(key: Column, mean: Column, seed: int) -> Column:
    """How often a document is repeated. key: a text that is never null."""
    parts = F.greatest(F.ceil(mean / PART_MEAN), F.lit(1)).cast("int")
    one = lambda i: poisson(uniform(key, F.lit(seed), i), mean / parts)
    return F.when(mean > 0, F.aggregate(F.transform(F.sequence(F.lit(1), parts), one), F.lit(0), lambda a, x: a + x)).otherwise(0)


def rates(docs: DataFrame, source: str, text: str, targets: dict[str, float] | None, alpha: float, budget: float | None) -> DataFrame:
    """One row (place, rate) for each source. targets: share of each source, which need not sum to 1 (others get none);
    without it a share is mass ** alpha. budget: bytes of the mixture, by default those of docs."""
    mass = docs.select(keyed(F.col(source)).alias("place"), F.octet_length(F.coalesce(F.col(text), F.lit(""))).alias("b"))
    sources = table(mass.groupBy("place").agg(F.sum("b").alias("mass")), "sources")
    if targets is None:
        share = F.pow(F.col("mass").cast("double"), F.lit(alpha))
    else:
        share = F.lit(0.0)
        for name, weight in targets.items():
            share = F.when(F.col("place") == f"={name}", F.lit(float(weight))).otherwise(share)
    shares = sources.withColumn("share", F.when(F.col("mass") > 0, share).otherwise(0.0))
    total = shares.agg(F.sum("share").alias("share"), F.sum("mass").alias("mass")).first()
    size = float(budget if budget is not None else total["mass"] or 0)
    rate = F.when((F.col("mass") > 0) & F.lit((total["share"] or 0) > 0), F.lit(size) * F.col("share") / F.lit(float(total["share"] or 1)) / F.col("mass"))
    return shares.select("place", "mass", "share", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def _named(rows: DataFrame, key: str) -> DataFrame:
    """rows whose column key, a text, tells them apart: those of one key get a hash of their row added, and a number among equal rows.

    Equal rows are counted and written out again, as they are alike, so that names follow from what the rows hold and not from where they are."""
    again = table(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(key, F.lit(True).alias("_again")), "again")
    if not again.limit(1).count():
        return rows
    held = lookup_join(rows, again, key)
    alone = held.filter(F.col("_again").isNull()).drop("_again")
    some = held.filter("_again").withColumn("_hash", F.md5(F.to_json("row")))
    equal = table(some.groupBy(key, "place", "_hash").agg(F.first("row").alias("row"), F.count(F.lit(1)).alias("_n")), "equal-rows")
    most = equal.agg(F.max("_n")).first()[0]
    # a table, as the optimizer loses fields of row that are read beyond several explodes
    each = table(repeated(equal, "_n", "_no", most), "each-row").withColumn(key, F.concat_ws("#", key, "_hash", F.col("_no").cast("string")))
    return alone.unionByName(each.select(alone.columns))


def mix(docs: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id", targets: dict[str, float] | None = None, alpha: float = 0.5, budget: float | None = None, seed: int = 17) -> DataFrame:
    """row (struct of docs' columns), rate, copy (from 0) and mix, the hash by which copies are dealt and sorted."""
    by_source = table(rates(docs, source, text, targets, alpha, budget), "rates").select("place", "rate")
    rows = _named(docs.select(F.struct(*docs.columns).alias("row"), keyed(F.col(source)).alias("place"), keyed(F.col(key)).alias("_key")), "_key")
    n = counts(F.col("_key"), F.col("rate"), seed)
    drawn = lookup_join(rows, by_source, "place").withColumn("_n", n).filter("_n > 0")
    copies = drawn.select("row", "_key", "rate", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("copy"))
    dealt = copies.select("row", "rate", "copy", digits(F.col("_key"), F.lit(seed), F.lit("mix"), F.col("copy"), n=15).alias("mix"))
    return dealt.repartition("mix").sortWithinPartitions("mix")
