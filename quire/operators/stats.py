"""Corpus statistics: one aggregation pass each (partial aggregation map-side)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import word_tokens


def length_bands(df: DataFrame, text_col: str = "text", low: int = 512, high: int = 4096) -> DataFrame:
    """Percent of documents with at most ``low`` words, between, and above ``high``."""
    n = F.size(word_tokens(text_col))
    return df.select(n.alias("n")).agg(
        (F.sum(F.when(F.col("n") <= low, 1).otherwise(0)) * 100.0 / F.count(F.lit(1))).alias("pct_below"),
        (F.sum(F.when((F.col("n") > low) & (F.col("n") <= high), 1).otherwise(0)) * 100.0
         / F.count(F.lit(1))).alias("pct_between"),
        (F.sum(F.when(F.col("n") > high, 1).otherwise(0)) * 100.0 / F.count(F.lit(1))).alias("pct_above"),
    )


def class_counts(df: DataFrame, label_col: str = "label") -> DataFrame:
    return df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))


def chunk_histogram(df: DataFrame, text_col: str = "text", size: int = 510) -> DataFrame:
    """Number of documents per ``words // size + 1`` value, in key order."""
    k = (F.floor(F.size(word_tokens(text_col)) / size) + 1).cast("int")
    return df.select(k.alias("n_chunks")).groupBy("n_chunks").agg(F.count(F.lit(1)).alias("n_docs")).orderBy("n_chunks")


def long_doc_counts(df: DataFrame, text_col: str = "text", over: tuple[int, int] = (2000, 5000)) -> DataFrame:
    """Longest document in words and how many documents exceed each threshold."""
    n = F.size(word_tokens(text_col))
    return df.select(n.alias("n")).agg(
        F.max("n").alias("max_words"),
        *[F.sum(F.when(F.col("n") > t, 1).otherwise(0)).cast("long").alias(f"over_{t}") for t in over],
    )
