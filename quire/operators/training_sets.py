"""Training sets built from chunk tables: region views, unions, prompt rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed value: task prefix of the label-generating variant.
TASK_NAME = "binary classification"


def region_training_set(chunks: DataFrame, region: int, splits=("train", "dev"),
                        text_col: str = "chunk", label_col: str = "label_idx") -> DataFrame:
    """``(split, text, labels)`` of one region for the given splits."""
    return (chunks.filter((F.col("region") == region) & F.col("split").isin(list(splits)))
            .select("split", F.col(text_col).alias("text"), F.col(label_col).alias("labels")))


def union_regions(chunks: DataFrame, split: str, text_col: str = "chunk", label_col: str = "label_idx") -> DataFrame:
    """All regions of one split as one training set (the long layout needs no
    explicit union; a filter on the split is enough)."""
    return chunks.filter(F.col("split") == split).select(
        "region", F.col(text_col).alias("text"), F.col(label_col).alias("labels"))


def prompt_rows(df: DataFrame, text_col: str = "text", label_col: str = "labels", task: str = TASK_NAME) -> DataFrame:
    """Training rows ``(prefix, input_text, target_text)``: constant prefix, label as text."""
    return df.select(F.lit(task).alias("prefix"), F.col(text_col).alias("input_text"),
                     F.col(label_col).cast("string").alias("target_text"))


def prediction_prompt(text_col: str = "chunk", task: str = TASK_NAME):
    """Prediction input ``task + ":" + text`` (no space after the colon)."""
    return F.concat(F.lit(task + ":"), F.col(text_col))
