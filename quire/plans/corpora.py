"""Queries over raw corpus layouts: the given tables are written in a layout's files in the shared folder,
then read, prepared and returned through the library's readers, writers and preparation jobs.

Writing the files only makes stand-in input in the layout's schema.  Values come back as digests, so
that every byte of a text counts in the comparison with SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import stats as S
from quire.plans.prepare import prepare_cases, prepare_news
from quire.sources.readers import read_flagged_corpus, read_json_records, read_paragraph_corpus, read_tsv_corpus
from quire.sources.sinks import write_report, write_row_files, write_tsv_corpus
from quire.session import stored_folder, table

SPLIT_BYTES = 4 * 1024 * 1024  # of the one-file-many-tasks readers


def q_tsv_corpus(spark, d) -> DataFrame:
    """documents as a quoted tab-separated corpus, read by byte range."""
    docs = table(spark, d, "documents").select("text", "lang", "source", "doc_id")
    path = write_tsv_corpus(docs, stored_folder(spark), "docs", "all")
    back = read_tsv_corpus(spark, path, "text string, lang string, source string, doc_id long", SPLIT_BYTES)
    return back.select("doc_id", "lang", "source", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def q_json_records(spark, d) -> DataFrame:
    """documents as JSON lists of records with nested lists, read by byte range."""
    # the nested lists are made after the rows have moved
    record = lambda r: F.struct(r["doc_id"].alias("doc_id"), r["text"].alias("text"),
                                F.struct(r["lang"].alias("lang"), F.split(r["text"], "\n").alias("lines")).alias("about"))
    lists = (table(spark, d, "documents").groupBy(F.floor(F.col("doc_id") / 500).alias("part"))
             .agg(F.collect_list(F.struct("doc_id", "text", "lang")).alias("rows"))
             .select(F.to_json(F.transform("rows", record)).alias("value")))
    path = stored_folder(spark)
    lists.write.text(path)
    schema = "doc_id long, text string, about struct<lang: string, lines: array<string>>"
    back = read_json_records(spark, path, schema, SPLIT_BYTES)
    return back.select("doc_id", F.col("about.lang").alias("lang"), F.md5("text").alias("text_md5"),
                       F.md5(F.array_join("about.lines", "\n")).alias("lines_md5"))


def _split(n: str):
    return F.when(F.col(n) % 10 == 0, "test").when(F.col(n) % 10 == 1, "validation").otherwise("train")


def q_paragraph_corpus(spark, d) -> DataFrame:
    """documents in split folders of paragraph lists."""
    docs = table(spark, d, "documents").select(
        "doc_id", F.split("text", "\n").alias("facts"), F.array(F.length("lang")).alias("silver_rationales"), _split("doc_id").alias("split"))
    root = stored_folder(spark)
    for split in ("train", "test", "validation"):
        docs.where(F.col("split") == split).drop("split").write.parquet(f"{root}/{split}")
    back = read_paragraph_corpus(spark, root)
    return back.select("doc_id", "split", F.size("facts").cast("long").alias("n_facts"), F.md5(F.array_join("facts", "\n")).alias("text_md5"),
                       F.size("silver_rationales").cast("long").alias("n_rationales"))


def q_flagged_corpus(spark, d) -> DataFrame:
    """labelled documents with a boolean flag in split folders."""
    rows = (table(spark, d, "documents").select("doc_id", "text").join(table(spark, d, "labels"), "doc_id")
            .select("doc_id", "text", (F.col("toxic") == 1).alias("hyperpartisan"), F.when(F.col("doc_id") % 5 == 0, "validation").otherwise("train").alias("split")))
    root = stored_folder(spark)
    for split in ("train", "validation"):
        rows.where(F.col("split") == split).drop("split").write.parquet(f"{root}/{split}")
    return read_flagged_corpus(spark, root).select("doc_id", "split", "labels", F.md5("text").alias("text_md5"))


def q_prepare_cases(spark, d) -> DataFrame:
    """pages as case files, one JSON object each, prepared into tab-separated splits."""
    some = lambda when, value: F.when(when, F.array(value)).otherwise(F.array().cast("array<string>"))
    case = F.to_json(F.struct(
        F.split("html", "\n").alias("TEXT"), some(F.col("page_id") % 3 == 0, F.lit("3")).alias("VIOLATED_ARTICLES"),
        some(F.col("page_id") % 5 == 0, F.lit("3-1")).alias("VIOLATED_PARAGRAPHS"), some(F.col("page_id") % 7 == 0, F.lit("a")).alias("VIOLATED_BULLETPOINTS")))
    split = F.when(F.col("page_id") % 10 == 0, "test").when(F.col("page_id") % 10 == 1, "dev").otherwise("train")
    root = stored_folder(spark)
    write_row_files(table(spark, d, "pages").select(split.alias("folder"), case.alias("value")), f"{root}/raw", ("train", "test", "dev"))
    paths = prepare_cases(spark, f"{root}/raw/train", f"{root}/raw/test", f"{root}/raw/dev", f"{root}/out")
    out = None
    for split, path in paths.items():
        text = F.array_join(F.from_json("text", "array<string>"), "\n")
        part = read_tsv_corpus(spark, path).select(F.lit(split).alias("split"), "labels", F.md5(text).alias("text_md5"))
        out = part if out is None else out.unionByName(part)
    return out


def q_prepare_news(spark, d) -> DataFrame:
    """pages as a folder corpus, one file each under its label, prepared into one tab-separated file."""
    files = table(spark, d, "pages").select(
        F.concat(F.lit("group="), F.coalesce((F.col("page_id") % 4).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))).alias("folder"),
        F.regexp_replace(F.coalesce("html", F.lit("")), r"[^\x00-\x7F]", "?").alias("value"))
    root = stored_folder(spark)
    write_row_files(files, f"{root}/raw")
    back = read_tsv_corpus(spark, prepare_news(spark, f"{root}/raw", f"{root}/out"))
    return back.select(F.regexp_extract("labels", r"([0-9]+)$", 1).alias("labels"), F.md5("text").alias("text_md5"))


def q_report(spark, d) -> DataFrame:
    """The length bands as a stored report."""
    path = stored_folder(spark)
    write_report(S.length_bands(table(spark, d, "documents")), path)
    bands = spark.read.json(path)
    return bands.select(*[F.round(c, 6).alias(c) for c in ("pct_below", "pct_between", "pct_above")])


QUERIES = {
    "tsv_corpus": q_tsv_corpus,
    "json_records": q_json_records,
    "paragraph_corpus": q_paragraph_corpus,
    "flagged_corpus": q_flagged_corpus,
    "prepare_cases": q_prepare_cases,
    "prepare_news": q_prepare_news,
    "report": q_report,
}

ORACLE = {
    "tsv_corpus": "SELECT doc_id, lang, source, CAST(length(text) AS BIGINT) AS n_chars, md5(text) AS text_md5 FROM documents",
    "json_records": "SELECT doc_id, lang, md5(text) AS text_md5, md5(text) AS lines_md5 FROM documents",
    "paragraph_corpus": """SELECT doc_id, CASE doc_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split,
  CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_facts, md5(text) AS text_md5, CAST(1 AS BIGINT) AS n_rationales FROM documents""",
    "flagged_corpus": """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split,
  CAST(toxic = 1 AS INTEGER) AS labels, md5(text) AS text_md5 FROM documents JOIN labels USING (doc_id)""",
    "prepare_cases": """SELECT CASE page_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'dev' ELSE 'train' END AS split,
  CASE WHEN page_id % 3 = 0 OR page_id % 5 = 0 OR page_id % 7 = 0 THEN '1' ELSE '0' END AS labels, md5(html) AS text_md5 FROM pages""",
    "prepare_news": r"""SELECT CAST(page_id % 4 AS VARCHAR) AS labels, md5(regexp_replace(
  regexp_replace(coalesce(html, ''), '[^\x00-\x7F]', '?', 'g') || chr(10), '\r\n|[\r\n\t]', ' ', 'g')) AS text_md5 FROM pages""",
    "report": """SELECT round(100.0 * count(*) FILTER (n <= 512) / count(*), 6) AS pct_below,
  round(100.0 * count(*) FILTER (n > 512 AND n <= 4096) / count(*), 6) AS pct_between,
  round(100.0 * count(*) FILTER (n > 4096) / count(*), 6) AS pct_above
FROM (SELECT len(string_split(text, ' ')) AS n FROM documents)""",
}
