"""Corpus preparation jobs: raw files -> labelled tab-separated corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import flatten_whitespace
from quire.operators.labels import label_any_nonempty
from quire.sources.readers import read_case_json, read_folder_corpus
from quire.sources.sinks import write_tsv_corpus


def label_cases(cases: DataFrame) -> DataFrame:
    """``(file_name, text, labels)``: 0 when no article, paragraph or bullet point was violated, else 1."""
    sizes = [F.coalesce(F.size(c), F.lit(0)) for c in ("VIOLATED_ARTICLES", "VIOLATED_PARAGRAPHS", "VIOLATED_BULLETPOINTS")]
    return cases.select("file_name", F.col("TEXT").alias("text"), label_any_nonempty(*sizes).alias("labels"))


def prepare_cases(spark: SparkSession, train_dir: str, test_dir: str, dev_dir: str, out_dir: str,
                  prefix: str = "cases") -> dict[str, str]:
    """Each split folder of case files becomes ``<out>/<prefix>_<split>.csv``."""
    out = {}
    for split, d in (("train", train_dir), ("test", test_dir), ("dev", dev_dir)):
        df = label_cases(read_case_json(spark, d)).select("text", "labels")
        out[split] = write_tsv_corpus(df, out_dir, prefix, split)
    return out


def news_corpus(spark: SparkSession, directory: str) -> DataFrame:
    """``(text, labels, decode_error)``: folder name as label, line breaks and tabs flattened."""
    df = read_folder_corpus(spark, directory)
    return df.select(flatten_whitespace("text").alias("text"), F.col("label").alias("labels"), "decode_error")


def prepare_news(spark: SparkSession, directory: str, out_dir: str, prefix: str = "news", undecodable: str = "fail") -> str:
    """``undecodable`` says what happens to files that are no valid Windows-1252: ``fail`` stops the
    job at the first one, ``drop`` leaves them out, ``flag`` keeps them with the flag column."""
    df = news_corpus(spark, directory)
    if undecodable == "fail":
        text = F.when(F.col("decode_error"), F.raise_error(F.lit("a file is not valid Windows-1252"))).otherwise(F.col("text"))
        df = df.select(text.alias("text"), "labels")
    elif undecodable == "drop":
        df = df.filter(~F.col("decode_error")).select("text", "labels")
    elif undecodable != "flag":
        raise ValueError(f"undecodable={undecodable!r}; known: fail, drop, flag")
    return write_tsv_corpus(df, out_dir, prefix, "all")
