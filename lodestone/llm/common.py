"""Helpers shared by the corpus operators: shared storage, bounded broadcasts, ASCII tokens."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import leave_at_exit, shared_dir, stored

#: Characters that separate words: space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes of its files up to which a materialised and counted table may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 1 << 25
#: Whether Spark removes a statement's shuffle files once it is done.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Keys that are joined apart because each has more than this share of the rows.
HOT_KEYS = 10_000


def table(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df written to the shared folder and read again: cuts the lineage, and survives lost executors.

    by: a column whose values get folders of their own, so that a filter on it reads no others.
    The files go when the driver's JVM ends."""
    if by is None:
        return stored(df, name)
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone-{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(by).option("compression", "zstd").parquet(path)
    leave_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Removes the files of a table() that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = jvm.org.apache.hadoop.fs.Path(name)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it, the files of a statement's shuffles leave the executors' disks at the end of the statement, as a table() holds its rows by then."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLE_CLEANUP)
        else:
            spark.conf.set(SHUFFLE_CLEANUP, before)


def small(df: DataFrame, rows: int | None = None) -> bool:
    """True if a table() has at most so many rows (BROADCAST_ROWS) and BROADCAST_BYTES bytes; reads one row more than that at most."""
    rows = BROADCAST_ROWS if rows is None else rows
    held = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return held <= BROADCAST_BYTES and df.limit(rows + 1).count() <= rows


def keyed(column: Column) -> Column:
    """A join key that is never null and keeps null apart from every string."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("null"))


def digits(*parts: Column, n: int = 13) -> Column:
    """The first n hexadecimal digits of the md5 of the parts, joined by colons, as a whole number."""
    text = F.concat_ws(":", *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, n), 16, 10).cast("long")


def uniform(*parts: Column) -> Column:
    """A double in (0, 1) hashed from the parts, none of which is null. 52 bits of md5, so that SQL engines draw the same."""
    return (digits(*parts).cast("double") + 0.5) / float(1 << 52)


def lookup_join(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """left joined (left or inner) to right, a table() with one row for each key.

    A right side of checked size is broadcast. With a larger one, keys that hold more than one in HOT_KEYS of left's rows,
    which are HOT_KEYS at most, are joined by broadcasting their rows of right; the others are shuffled; null keys,
    which match nothing, are not."""
    if small(right):
        return left.join(F.broadcast(right), key, how)
    every = left.count() // HOT_KEYS
    hot = table(left.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter((F.col("_n") > every) & F.col(key).isNotNull()).orderBy(F.desc("_n")).limit(HOT_KEYS).select(key), "hot")
    some = F.broadcast(hot)
    out = left.filter(F.col(key).isNotNull()).join(some, key, "left_anti").join(right, key, how)
    out = out.unionByName(left.join(some, key, "left_semi").join(F.broadcast(right.join(some, key, "left_semi")), key, how))
    if how == "left":
        none = right.schema
        out = out.unionByName(left.filter(F.col(key).isNull()).select("*", *(F.lit(None).cast(none[c].dataType).alias(c) for c in right.columns if c != key)))
    return out


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, A to Z in lower case. bytes.split() cuts at exactly the characters that WORD leaves out."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


#: Copies of one row that a task writes at a time.
COPIES = 100_000


def repeated(df: DataFrame, n: str, ordinal: str, most: int) -> DataFrame:
    """df with each row n times (most at most), ordinal from 0; rows that occur very often are spread over tasks before they are written out."""
    rest = df.columns
    df = df.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1, F.lit(COPIES).cast("long"))))
    if most > COPIES:
        df = df.repartition("_from", *rest)
    last = F.least(F.col(n), F.col("_from") + COPIES) - 1
    return df.withColumn(ordinal, F.explode(F.sequence(F.col("_from"), last))).drop("_from")
