"""Corpus readers.  Each returns a DataFrame; nothing is read on the driver."""

from __future__ import annotations

import math
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.sources.ranges import SPLIT_BYTES, read_records

CASE_SCHEMA = T.StructType([
    T.StructField("TEXT", T.ArrayType(T.StringType())),
    T.StructField("VIOLATED_ARTICLES", T.ArrayType(T.StringType())),
    T.StructField("VIOLATED_PARAGRAPHS", T.ArrayType(T.StringType())),
    T.StructField("VIOLATED_BULLETPOINTS", T.ArrayType(T.StringType())),
])

TSV_SCHEMA = T.StructType([T.StructField("text", T.StringType()), T.StructField("labels", T.StringType())])


def packed(rows: DataFrame, files: DataFrame) -> DataFrame:
    """``rows`` of a scan of many small ``files`` in tasks of about ``SPLIT_BYTES`` (no shuffle), at least four per core:
    Spark counts a small file as several megabytes, and its tasks, and what they write, would grow with the files."""
    size = int(str(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.coalesce(max(files.sparkSession.sparkContext.defaultParallelism * 4, math.ceil(size / SPLIT_BYTES)))


def read_case_json(spark: SparkSession, directory: str, schema: T.StructType = CASE_SCHEMA) -> DataFrame:
    """One JSON object per file; the file name is kept as ``file_name``.  A malformed
    file fails the read: it must not turn into a case without any violation."""
    df = spark.read.option("multiLine", True).option("mode", "FAILFAST").schema(schema).json(directory)
    return packed(df.select(F.col("_metadata.file_name").alias("file_name"), *schema.fieldNames()), df)


# The Windows-1252 characters of bytes 0x80-0x9F, in byte order
# (bytes 0x81, 0x8D, 0x8F, 0x90 and 0x9D are undefined).
CP1252_HIGH = {
    0x80: "€", 0x82: "‚", 0x83: "ƒ", 0x84: "„", 0x85: "…", 0x86: "†",
    0x87: "‡", 0x88: "ˆ", 0x89: "‰", 0x8A: "Š", 0x8B: "‹", 0x8C: "Œ",
    0x8E: "Ž", 0x91: "‘", 0x92: "’", 0x93: "“", 0x94: "”", 0x95: "•",
    0x96: "–", 0x97: "—", 0x98: "˜", 0x99: "™", 0x9A: "š", 0x9B: "›",
    0x9C: "œ", 0x9E: "ž", 0x9F: "Ÿ",
}
CP1252_UNDEFINED = (0x81, 0x8D, 0x8F, 0x90, 0x9D)


def decode_cp1252(content) -> F.Column:
    """Bytes to text as Windows-1252: Latin-1 decoding maps every byte to the
    code point of the same value, then the 0x80-0x9F range is translated."""
    latin = F.decode(content, "ISO-8859-1")
    src = "".join(chr(b) for b in CP1252_HIGH)
    dst = "".join(CP1252_HIGH.values())
    return F.translate(latin, src, dst)


def universal_newlines(text) -> F.Column:
    """Text-mode reading: ``\\r\\n`` and lone ``\\r`` become ``\\n``."""
    return F.regexp_replace(text, "\r\n|\r", "\n")


def read_folder_corpus(spark: SparkSession, directory: str) -> DataFrame:
    """``(path, label, text, decode_error)``: every file under ``<dir>/<label>/``,
    decoded as Windows-1252.  Files holding a byte that encoding leaves
    undefined are flagged (a strict decoder would refuse them)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(directory)
    raw = packed(files.select("path", "content"), files)
    latin = F.decode(F.col("content"), "ISO-8859-1")
    bad = "[" + "".join(chr(b) for b in CP1252_UNDEFINED) + "]"
    return raw.select(
        "path",
        F.element_at(F.split(F.col("path"), "/"), -2).alias("label"),
        universal_newlines(decode_cp1252(F.col("content"))).alias("text"),
        latin.rlike(bad).alias("decode_error"),
    )


def read_tsv_corpus(spark: SparkSession, path: str, schema: T.StructType | str = TSV_SCHEMA, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Tab-separated file(s) with a header row, as ``write_tsv_corpus`` writes them: white space,
    quotes, line breaks, empty strings and nulls come back as they were.  Columns go by position; values that
    aren't of their column's type are null, missing ones too, and surplus ones fail the read.  Files are read by
    ranges of ``split_bytes``, also where quoted fields hold line breaks (see ``ranges``)."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    rows = read_records(spark, path, "table", split_bytes, skip_first=True, columns=len(schema.fields))
    return rows.select(*[F.get("fields", F.lit(i)).try_cast(f.dataType).alias(f.name) for i, f in enumerate(schema.fields)])


def read_json_records(spark: SparkSession, path: str, schema: T.StructType | str | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """File(s) holding a JSON list of records, or records one after another; each object becomes a row.
    Files are read by ranges of ``split_bytes``.  Without a schema it is inferred from all records."""
    records = read_records(spark, path, "json", split_bytes)
    if schema is None:
        # The values as a dataset of strings: Spark's own reader infers and parses.
        values = getattr(records._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
        return DataFrame(spark._jsparkSession.read().json(values), spark)
    return records.select(F.from_json("value", schema).alias("r")).select("r.*")


def _read_splits(spark: SparkSession, root: str, splits: dict[str, str]) -> DataFrame:
    out = None
    for folder, split in splits.items():
        df = spark.read.parquet(os.path.join(root, folder)).withColumn("split", F.lit(split))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def read_paragraph_corpus(spark: SparkSession, root: str) -> DataFrame:
    """``facts`` (list of paragraphs) and ``silver_rationales`` per split
    folder ``train``, ``test``, ``validation``; the split is a column."""
    return _read_splits(spark, root, {"train": "train", "test": "test", "validation": "validation"})


def read_flagged_corpus(spark: SparkSession, root: str, flag: str = "hyperpartisan") -> DataFrame:
    """``text`` and a boolean flag as int ``labels``; the ``validation`` folder serves as test."""
    df = _read_splits(spark, root, {"train": "train", "validation": "test"})
    return df.withColumn("labels", F.col(flag).cast("int")).drop(flag)
