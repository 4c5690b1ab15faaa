"""Lines that many documents share are dropped from all but one of them.

Line hashes are kept in levelled runs, sorted and bucketed by hash. Each batch is merge-anti-joined with the runs: what they
have settled already is not added again, the rest becomes a run of its own. A level that is full is compacted into one run
of the next level. Runs have the same buckets and are sorted within them, so joins of runs neither shuffle nor gather.

A line's key is the line without the white space at its ends, A to Z in lower case. A key of at least LENGTH code points that
at least DOCS documents hold loses its lines everywhere but in the document of the largest id. A run has one row for each
hash: the number of documents that hold it and the largest id of them. Sums and maxima do not depend on the order of
batches. Hashes have 128 bits.

Defined cases: a null text is an empty one, which is one empty line; a null id is below every id; rows count as documents, so that
repeated rows count each, and of several rows with the largest id all keep the line; if only rows without an id hold a key,
none loses it; a document may lose all its lines and then is empty; texts of any length are read whole; an empty table gives
no rows; other columns of docs travel in one struct, so that names never clash.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import leave_at_exit, shared_dir
from .common import drop_table, keyed, lookup_join, table

SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Code points of a key, and documents that hold it.
LENGTH, DOCS = 20, 3
#: Batches in which dedup() adds a table, and runs of a level that are compacted into one.
BATCHES, FANOUT = 6, 3
#: Line hashes for each bucket of the runs.
BUCKET_ROWS = 2_000_000


class LineRuns:
    """Runs by level. A row of a run: h, docs (documents that hold it), keeper (the largest id of them)."""

    def __init__(self, spark: SparkSession, buckets: int) -> None:
        self.spark, self.buckets = spark, buckets
        self.levels: list[list[str]] = []

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def add(self, batch: DataFrame) -> None:
        """Adds a batch of lines (h, id), one row for each hash and document.

        A hash is left out if a run has enough documents for it and an id as large as the batch's: the batch changes nothing about it."""
        own = batch.groupBy("h").agg(F.count(F.lit(1)).alias("docs"), F.max("id").alias("keeper"))
        for run in self.runs():
            known = run.filter(F.col("docs") >= DOCS).select(F.col("h").alias("_h"), F.col("keeper").alias("_keeper"))
            settled = F.col("keeper").isNull() | (F.col("_keeper") >= F.col("keeper"))
            own = own.join(known, (F.col("h") == F.col("_h")) & settled, "left_anti")
        self._put(own, 0)

    def merged(self) -> DataFrame:
        """All runs as one, merged bucket by bucket."""
        return _merged(self.runs())

    def drop(self) -> None:
        """Removes all runs."""
        for level in self.levels:
            for name in level:
                self._remove(name)
        self.levels = []

    def _put(self, run: DataFrame, level: int) -> None:
        name = f"lodestone_lines_{uuid.uuid4().hex}"
        path = f"{shared_dir(self.spark)}/{name}"
        dealt = run.repartition(self.buckets, "h")
        dealt.write.bucketBy(self.buckets, "h").sortBy("h").option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
        leave_at_exit(self.spark, path)
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) == FANOUT:
            full, self.levels[level] = self.levels[level], []
            self._put(_merged([self.spark.table(n) for n in full]), level + 1)
            for n in full:
                self._remove(n)

    def _remove(self, name: str) -> None:
        run = self.spark.table(name)
        drop_table(run)
        self.spark.sql(f"DROP TABLE {name}")


def _merged(runs: list[DataFrame]) -> DataFrame:
    out = runs[0]
    for run in runs[1:]:
        other = run.select("h", F.col("docs").alias("_docs"), F.col("keeper").alias("_keeper"))
        docs = F.coalesce("docs", F.lit(0)) + F.coalesce("_docs", F.lit(0))
        out = out.hint("merge").join(other, "h", "full_outer").select("h", docs.alias("docs"), F.greatest("keeper", "_keeper").alias("keeper"))
    return out


def _split(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def _document(id: str, text: str) -> Column:
    """What documents that lose the same lines share: id and text."""
    return F.md5(F.concat(F.md5(keyed(F.col(id))), F.md5(F.coalesce(F.col(text), F.lit("")))))


def keys(docs: DataFrame, id: str, text: str) -> DataFrame:
    """doc, id, h, at (the line's place) and first (whether it is the first of its key in the document) of every line whose key is long enough."""
    key = lambda x: F.translate(F.btrim(x, F.lit(SPACES)), UPPER, LOWER)
    long = F.filter(F.transform(F.col("_lines"), lambda x, i: F.struct(key(x).alias("k"), i.alias("at"))), lambda x: F.length(x["k"]) >= LENGTH)
    one = docs.select(_document(id, text).alias("doc"), F.col(id).alias("id"), _split(text).alias("_lines"))
    two = one.select("doc", "id", F.transform(long, lambda x: F.struct(F.unhex(F.md5(x["k"])).alias("h"), x["at"].alias("at"))).alias("_hashes"))
    # equal hashes of a document stand together, in order of their places
    three = two.select("doc", "id", F.sort_array("_hashes").alias("_hashes"))
    marked = F.transform("_hashes", lambda x, i: F.struct(x["h"].alias("h"), x["at"].alias("at"), F.coalesce(F.get("_hashes", i - 1)["h"] != x["h"], F.lit(True)).alias("first")))
    return three.select("doc", "id", F.inline(marked))


def shared(lines: DataFrame, batches: int = BATCHES) -> DataFrame:
    """h and keeper of the keys that enough documents hold, from a table of keys() with a column batch from 0."""
    runs = LineRuns(lines.sparkSession, 1 + lines.count() // BUCKET_ROWS)
    for i in range(batches):
        runs.add(lines.filter(F.col("first") & (F.col("batch") == i)))
    found = table(runs.merged().filter((F.col("docs") >= DOCS) & F.col("keeper").isNotNull()).select("h", "keeper"), "shared-lines")
    runs.drop()
    return found


def dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", batches: int = BATCHES) -> DataFrame:
    """docs' rows (struct row), n_lines, n_dropped and kept, the text of the lines that stay."""
    batch = F.pmod(F.xxhash64("doc"), F.lit(batches)).alias("batch")
    lines = table(keys(docs, id, text).select("*", batch), "lines", by="batch")
    some = lookup_join(lines, shared(lines, batches), "h", "inner").filter(F.col("id").isNull() | (F.col("id") < F.col("keeper")))
    gone = table(some.groupBy("doc").agg(F.sort_array(F.collect_set("at")).alias("gone")), "dropped-lines")
    whole = docs.select(F.struct(*docs.columns).alias("row"), _document(id, text).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    out = lookup_join(whole, gone, "doc")
    dropped = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone"))
    at = lambda k: F.coalesce(F.get("gone", k), F.size("_lines"))
    before = lambda k: F.coalesce(F.get("gone", k - 1), F.lit(-1))
    # what stands between the dropped lines
    pieces = F.transform(F.sequence(F.lit(0), F.size("gone")), lambda k: F.slice("_lines", before(k) + 2, at(k) - before(k) - 1))
    kept = F.when(F.col("gone").isNull(), F.col("_text")).otherwise(F.array_join(F.flatten(pieces), "\n"))
    return out.withColumn("_lines", _split("_text")).select("row", F.size("_lines").cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"), kept.alias("kept"))
