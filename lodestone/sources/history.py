"""Run history and stage snapshots: append-only tables; what is recent is a matter of reading.

Compaction keeps the history of a domain small. It writes the runs that are kept to a folder of its own and commits with a marker, a file that
appears by a rename; readers take the last marker's folder and of the appended rows those that came after. Rows that a marker stands for are deleted by the
compaction after it, so that who had begun to read before a commit can end.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reconcile import recent
from ..params import Reconcile
from ..schema import RUN


def load(spark: SparkSession, path: str, domain: str, params: Reconcile = Reconcile()) -> DataFrame:
    """The last runs of a domain (schema RUN); none if there is no table."""
    return recent(_rows(spark, path, domain, _marker(spark, path, domain)), params.kept_runs)


def _read(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(RUN).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], RUN)


def _late(marker: dict) -> Column:
    """Rows that a marker does not stand for: later runs, and those that were reserved but not written when it was made."""
    return (F.col("run_seq") > marker["upto"]) | F.col("run_seq").isin(marker["open"])


def _rows(spark: SparkSession, path: str, domain: str, marker: dict | None) -> DataFrame:
    rows = _read(spark, path).filter(F.col("domain") == domain)
    if marker is None:
        return rows
    return rows.filter(_late(marker)).unionByName(_read(spark, f"{path}/{marker['folder']}"))


def _files(spark: SparkSession, path: str):
    """The path's file system, and a function that makes its paths."""
    jvm = spark.sparkContext._jvm
    make = jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def _folder(domain: str) -> str:
    return hashlib.md5(domain.encode()).hexdigest()


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    """Names of a folder's files that are numbers."""
    files, make = _files(spark, folder)
    if not files.exists(make(folder)):
        return []
    return sorted(int(x) for f in files.listStatus(make(folder)) if (x := f.getPath().getName()).isdigit())


def _marker(spark: SparkSession, path: str, domain: str) -> dict | None:
    """The last compaction of a domain: folder, upto, open."""
    folder = f"{path}/_compacted/{_folder(domain)}"
    last = _numbers(spark, folder)
    return json.loads(spark.read.text(f"{folder}/{last[-1]}").first()["value"]) if last else None


def compact(spark: SparkSession, path: str, domain: str, params: Reconcile = Reconcile()) -> None:
    """Keeps the last runs of a domain in one folder. May run beside readers and writers; of two compactions at once one has no effect."""
    before = _marker(spark, path, domain)
    files, make = _files(spark, path)
    folder = f"{path}/_compacted/{_folder(domain)}"
    markers = _numbers(spark, folder)
    every = _rows(spark, path, domain, before)
    seen = {r["run_seq"] for r in every.select("run_seq").distinct().collect()}  # a number a run
    if not seen:
        return
    upto = max(seen)
    missing = [n for n in _numbers(spark, f"{path}/_numbers/{_folder(domain)}") if n <= upto and n not in seen and (before is None or n > before["upto"] or n in before["open"])]
    old = [] if before is None else _read(spark, path).filter((F.col("domain") == domain) & ~_late(before)).select(F.input_file_name().alias("f")).distinct().collect()
    name = f"_compacted/{_folder(domain)}/runs-{uuid.uuid4().hex}"
    recent(every, params.kept_runs).coalesce(1).write.parquet(f"{path}/{name}")
    part = make(f"{folder}/.{uuid.uuid4().hex}")
    out = files.create(part)
    out.write((json.dumps({"folder": name, "upto": upto, "open": missing}) + "\n").encode())
    out.close()
    if not files.rename(part, make(f"{folder}/{1 + (markers[-1] if markers else 0)}")):
        files.delete(part, False)
        files.delete(make(f"{path}/{name}"), True)
        return
    for r in old:  # files of single runs that the marker before stands for
        files.delete(make(r["f"]), False)
    for n in markers[:-1]:
        stale = json.loads(spark.read.text(f"{folder}/{n}").first()["value"])["folder"]
        files.delete(make(f"{folder}/{n}"), False)
        files.delete(make(f"{path}/{stale}"), True)


def append(prompts: DataFrame, path: str, domain: str, timestamp: str, run_seq: int | None = None) -> None:
    """A run of a domain; its number follows the last one's, and no other writer gets the same."""
    spark = prompts.sparkSession
    if run_seq is None:
        last = load(spark, path, domain).agg(F.max("run_seq").alias("m")).first()["m"]
        run_seq = _reserved(spark, path, domain, 0 if last is None else last + 1)
    n = prompts.count()
    rows = prompts.select(
        F.lit(run_seq).cast("long").alias("run_seq"), F.lit(timestamp).cast("timestamp").alias("timestamp"), F.lit(n).cast("int").alias("prompt_count"), F.col("prompt_text").alias("text"),
        F.col("relevance_score").alias("score"), F.col("search_intent").alias("intent"), F.col("topic_cluster").alias("topic"), F.col("ord").cast("long").alias("ord"), F.lit(domain).alias("domain"),
    )
    rows.write.mode("append").partitionBy("domain").parquet(path)


def _reserved(spark: SparkSession, path: str, domain: str, number: int) -> int:
    """The first free number from number on: a marker file, which only one writer can create, takes it. Readers skip the markers' folder."""
    folder = f"{path}/_numbers/{_folder(domain)}"
    files, make = _files(spark, folder)
    while not files.createNewFile(make(f"{folder}/{number}")):
        number += 1
    return number


def save_stage(df: DataFrame, path: str, stage: str) -> DataFrame:
    """df as a table of its stage, read again."""
    df.write.mode("overwrite").parquet(f"{path}/{stage}")
    return load_stage(df.sparkSession, path, stage)


def load_stage(spark: SparkSession, path: str, stage: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{path}/{stage}")
    except AnalysisException:
        return None
