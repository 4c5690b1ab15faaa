"""Corpus preparation: the stages in order, each from the documents that the one before kept.

All but the last return the columns of documents; the last gives each document that is left, copies by weight among
them, its shard and slot.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontam, jaccard, mixing, quality
from lodestone.llm.common import table
from lodestone.llm.queries import JACCARD_SQL, LEAKS_SQL, MIXING_SQL, QUALITY_SQL, SHARDS_SQL, sharded


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither fail the rules themselves nor come from a host that fails them too often."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group."""
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate makes it; rows in a hashed order."""
    return mixing.mix(docs).select("row.*")


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row."""
    return sharded(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixture", mixture),
    ("shards", shards),
]


def _over(sql: str, name: str) -> str:
    """The SQL with another table in place of documents."""
    return re.sub(r"\bdocuments\b", name, sql)


#: Each stage's SQL over what the one before kept; where ids are not repeated, a group's document is the one of its class's id.
ORACLE_SQL = f"""
WITH good AS MATERIALIZED (SELECT documents.* FROM documents JOIN ({QUALITY_SQL}) q ON documents.doc_id = q.doc_id WHERE q.kept),
single AS MATERIALIZED (SELECT good.* FROM good JOIN ({_over(JACCARD_SQL, "good")}) j ON good.doc_id = j.doc_id WHERE j.class_id = j.doc_id),
clean AS MATERIALIZED (SELECT * FROM single WHERE doc_id NOT IN (SELECT doc_id FROM ({_over(LEAKS_SQL, "single")}))),
mixed AS MATERIALIZED (SELECT doc_id, source, text FROM ({_over(MIXING_SQL, "clean")}))
SELECT * FROM ({_over(SHARDS_SQL, "mixed")})
"""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
