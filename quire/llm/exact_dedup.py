"""Exact dedup by a tree-merge of sorted digest runs (DataFrame functions only).

Every input partition becomes one *run*: its rows reduced to (digest, identifier) entries.
Runs are then merged in binomial rounds: ``FAN_IN`` neighbouring runs meet, dealt by ranges
of the digest and sorted; equal digests, now neighbours, collapse to one entry holding the
smallest identifier and the number of rows, and the merged runs, sorted by digest, go on to
the next round until one is left.
A digest held by a third of all rows enters the first round as at most one entry per
partition and later rounds as at most ``FAN_IN`` entries per merged run, so no task
ever sees a hot group's rows together.

The merge key is the triple (SHA-256, 64-bit hash, byte length) of the normalised
text: texts that share a SHA-256 value but differ in either other member are never
merged.  Every round is written to the shared checkpoint folder and verified: the
merged entries must account for exactly the rows of the runs they came from.

Defined results: null text is empty text (so all null and empty texts are equal);
a null identifier ranks after all others; rows repeated in full are copies of each
other and exactly one of them, the first one read, is kept; very long texts are digested whole
in their own row; an empty table gives an empty result; other columns are read only where rows are
dropped, and travel in one struct, so their names never clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.joins import broadcast_if_small
from quire.llm.text import single_spaced
from quire.session import cut_lineage

FAN_IN = 16
KEY = ["sha", "fp", "nbytes"]


def digest_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_doc: bool = False) -> DataFrame:
    """One stored row per input row: id, row (unique), run (input partition), key, and with ``with_doc``
    the whole input row as the struct ``doc``."""
    doc = [F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc")] if with_doc else []
    norm = df.select(F.col(f"`{id_col}`").alias("id"), single_spaced(F.col(f"`{text_col}`")).alias("t"), *doc)
    return cut_lineage(norm.select(
        "id", F.monotonically_increasing_id().alias("row"), F.spark_partition_id().cast("long").alias("run"),
        F.sha2("t", 256).alias("sha"), F.xxhash64("t").alias("fp"), F.octet_length("t").cast("long").alias("nbytes"),
        *(["doc"] if with_doc else [])))


def _verify(level: DataFrame, rows: int, what: str) -> None:
    got = level.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    if got != rows:
        raise RuntimeError(f"{what} accounts for {got} rows, expected {rows}")


def merge_runs(rows: DataFrame, fan_in: int = FAN_IN) -> tuple[DataFrame, DataFrame]:
    """(first level, last level) of the merge tree over ``digest_runs`` output.

    The first level holds one entry per (run, key); the last one per key.  In every round the entries are
    dealt by ranges of (run, digest) and sorted, so that a task meets the entries of its digests from all the
    runs that merge side by side, and the sort-based aggregate collapses neighbours without a shuffle or sort of its own."""
    first = F.struct(F.col("id").isNull().alias("unknown"), "id", "row")
    total, runs = rows.agg(F.count(F.lit(1)), F.coalesce(F.max("run") + 1, F.lit(1))).first()
    local = cut_lineage(rows.groupBy("run", *KEY).agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n")))
    _verify(local, total, "first level")
    level = local
    while runs > 1:
        merged = (level.withColumn("run", F.floor(F.col("run") / fan_in)).repartitionByRange("run", *KEY)
                  .sortWithinPartitions("run", *KEY).groupBy("run", *KEY).agg(F.min("first").alias("first"), F.sum("n").alias("n")))
        level = cut_lineage(merged)
        _verify(level, total, "merged level")
        runs = -(-runs // fan_in)
    return local, level


def group_rows(rows: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """One row per row of ``digest_runs``: id, row, keep_id, group_size, kept, sha.

    The way back down: entries of the first level learn their group from the last one
    (at most one entry per run for any key), rows learn it from their own run's entry,
    so the copies of a hot text stay spread over as many keys as there are runs."""
    local, last = merge_runs(rows, fan_in)
    groups = last.select(*KEY, F.col("first").alias("keep"), F.col("n").alias("group_size"))
    entries = local.select("run", *KEY).join(groups, KEY)
    return (rows.select("id", "row", "run", *KEY).join(entries, ["run", *KEY])
            .select("id", "row", F.col("keep.id").alias("keep_id"), "group_size",
                    (F.col("row") == F.col("keep.row")).alias("kept"), "sha"))


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, sha."""
    return group_rows(digest_runs(df, id_col, text_col), fan_in).drop("row")


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """The rows of ``df`` (all columns) without exact copies: of equal texts the row with the smallest
    identifier stays (of rows that share it too, the first one read), exactly the row ``exact_groups`` marks.
    Identifiers and digests alone go through the merge.  Only the row numbers that go meet the stored rows
    again: broadcast where they are measured to be few, else by a shuffle."""
    rows = digest_runs(df, id_col, text_col, with_doc=True)
    gone = cut_lineage(group_rows(rows, fan_in).where(~F.col("kept")).select("row"))
    return (rows.select("row", "doc").join(broadcast_if_small(gone), "row", "left_anti")
            .select(*[F.col(f"doc.`{c}`").alias(c) for c in df.columns]))


def q_exact_dedup(spark, sf_dir) -> DataFrame:
    from quire.session import table

    g = exact_groups(table(spark, sf_dir, "documents"))
    return g.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


SQL_EXACT_DEDUP = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h
  FROM documents
), g AS (
  SELECT doc_id, h, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size
  FROM d
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, h AS text_sha256
FROM g
"""
