"""The corpus pipeline: quality rules, exact dedup, near dedup, mixing, packing.

Every stage is a function (spark, docs, sf_dir) -> DataFrame.  A stage reads all that its
predecessor kept; its result is written as Parquet and read again as the next one's docs.  All
stages but the last return the columns of ``documents``; the last returns packed pieces with
their token ids.

Nulls, empty and very long texts, repeated rows, empty tables and clashing column names are
handled as each operator's module says: rows without 50 words go in the first stage, of equal and
of nearly equal texts one row stays, a source short of its target repeats documents up to three
times, and every document that the mix takes is packed as often as it is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import exact_dedup, mixing, near_dedup, packing, quality_ledger
from quire.session import cut_lineage, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_ledger.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("packing", pack)]

# Near-duplicate classes and tokenisation have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
