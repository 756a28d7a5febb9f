"""Regions and chunks (the core one-row-to-many operator), and token windows.

A document's tokens are cut into ``n_regions`` contiguous near-equal regions;
a region longer than ``max_tokens`` is cut again into ``len // max_tokens + 1``
near-equal chunks.  All spans are computed inside the row with array
functions and emitted by one ``inline`` generator, so the token array is
dropped right after the generator and nothing but the chunk text is carried
downstream.  Chunk ids are functions of the data (doc id, region, sub), never
of the partitioning.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.arrays import part_index, part_len, part_start
from quire.functions.joins import broadcast_if_small
from quire.functions.ranking import global_row_number
from quire.functions.text import tokens_for
from quire.operators.features import shard_of
from quire.session import cut_lineage, store_bucketed

CHUNK_KEY = ["doc_id", "region", "sub"]


def _spans(tokens: Column, n_regions: int, max_tokens: int | None, only: int | None = None) -> Column:
    return _spans_of(F.size(tokens), n_regions, max_tokens, only)


def _spans_of(n: Column, n_regions: int, max_tokens: int | None, only: int | None = None) -> Column:
    """The chunks of ``n`` tokens: ``array<struct<region, sub, start, len>>``."""
    k_reg = F.lit(n_regions)

    def region_parts(i: Column) -> Column:
        r_start = part_start(i, n, k_reg)
        r_len = part_len(i, n, k_reg)
        if max_tokens is None:
            k_sub = F.lit(1)
        else:
            k_sub = F.when(r_len > max_tokens, F.floor(r_len / max_tokens).cast("int") + 1).otherwise(1)
        return F.transform(
            F.sequence(F.lit(0), k_sub - 1),
            lambda j: F.struct(
                i.alias("region"),
                j.alias("sub"),
                (r_start + part_start(j, r_len, k_sub)).alias("start"),
                part_len(j, r_len, k_sub).alias("len"),
            ),
        )

    regions = F.sequence(F.lit(0), F.lit(n_regions - 1)) if only is None else F.array(F.lit(only))
    return F.flatten(F.transform(regions, region_parts))


def chunk_documents(df: DataFrame, text_col: str = "text", n_regions: int = 3, max_tokens: int | None = 400,
                    unit: str = "word", keep: list[str] | None = None, only_region: int | None = None) -> DataFrame:
    """One row per (document, region, sub-chunk): ``keep + [region, sub, chunk]``.
    With ``only_region`` the text of the other regions is never built.

    ``unit`` picks the tokens (see :func:`quire.functions.text.tokens_for`).
    Label and document id are carried to every chunk by listing them in ``keep``.
    A document with fewer tokens than regions still yields its empty regions as
    empty-string chunks.  One region of words without a limit is the text itself (null of a null).
    """
    keep = list(keep if keep is not None else ["doc_id"])
    if n_regions == 1 and max_tokens is None and unit == "word":
        return df.select(*keep, F.lit(0).alias("region"), F.lit(0).alias("sub"), F.col(text_col).alias("chunk"))
    tok = "__tokens"
    with_tokens = df.select(*keep, tokens_for(text_col, unit).alias(tok))
    tokens = F.col(tok)
    chunks = F.transform(
        _spans(tokens, n_regions, max_tokens, only_region),
        lambda s: F.struct(
            s["region"].alias("region"),
            s["sub"].alias("sub"),
            F.array_join(F.slice(tokens, s["start"] + 1, s["len"]), " ").alias("chunk"),
        ),
    )
    return with_tokens.select(*keep, F.inline(chunks))


def _running_offsets(lengths: DataFrame) -> DataFrame:
    """``g, o, len`` plus ``off``, the group's tokens before ``o``.  Rows are range-partitioned on
    (g, o), so even one group that holds most rows is summed by many tasks; a group's partial
    sums are one row per partition."""
    ranged = cut_lineage(lengths.repartitionByRange("g", "o").withColumn("pid", F.spark_partition_id()))
    earlier = Window.partitionBy("g").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = (ranged.groupBy("g", "pid").agg(F.sum("len").alias("s"))
              .select("g", "pid", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("base")))
    before = Window.partitionBy("g", "pid").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.withColumn("run", F.coalesce(F.sum("len").over(before), F.lit(0)))
    return inside.join(starts, ["g", "pid"]).select("g", "o", "len", (F.col("base") + F.col("run")).cast("int").alias("off"))


def chunk_paragraphs(df: DataFrame, group_col: str, order_col: str, text_col: str = "text", n_regions: int = 3,
                     max_tokens: int = 400) -> DataFrame:
    """Regions and chunks of texts that come as one paragraph per row:
    ``group, region, sub, chunk``, as if the group's paragraphs were joined with one space.

    No group is joined into one row.  Token counts per paragraph give each one its offset in
    the group; a paragraph is cut where it crosses region or chunk ends, and only the pieces
    of one chunk (at most ``max_tokens`` tokens) meet again.  (group, order) must be unique."""
    tok = tokens_for(text_col, "word")
    lengths = df.select(F.col(group_col).alias("g"), F.col(order_col).alias("o"), F.size(tok).alias("len"))
    offsets = _running_offsets(lengths)
    total = offsets.groupBy("g").agg(F.sum("len").cast("int").alias("n"))
    n, off, size, k_reg = F.col("n"), F.col("off"), F.size("toks"), F.lit(n_regions)
    parts = (df.select(F.col(group_col).alias("g"), F.col(order_col).alias("o"), tok.alias("toks"))
             .join(offsets.select("g", "o", "off"), ["g", "o"]).join(total, "g"))

    def pieces_of(i: Column) -> Column:
        """This paragraph's pieces in region ``i``: only the chunks that it overlaps are listed."""
        start, length = part_start(i, n, k_reg), part_len(i, n, k_reg)
        a, b = F.greatest(off, start), F.least(off + size, start + length)
        subs = F.when(length > max_tokens, F.floor(length / max_tokens).cast("int") + 1).otherwise(1)

        def piece(j: Column) -> Column:
            p, q = start + part_start(j, length, subs), start + part_start(j, length, subs) + part_len(j, length, subs)
            return F.struct(i.alias("region"), j.alias("sub"), off.alias("at"), F.array_join(
                F.slice(F.col("toks"), F.greatest(p, off) - off + 1, F.least(q, off + size) - F.greatest(p, off)), " ").alias("piece"))

        return F.when(a < b, F.transform(F.sequence(
            part_index(a - start, length, subs), part_index(b - 1 - start, length, subs)), piece)).otherwise(
                F.array().cast("array<struct<region:int,sub:int,at:int,piece:string>>"))

    cut = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n_regions - 1)), pieces_of))
    pieces = parts.select("g", F.inline(cut))
    chunks = pieces.groupBy("g", "region", "sub").agg(F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("p"))
    empty = total.select("g", F.inline(F.filter(_spans_of(n, n_regions, max_tokens), lambda s: s["len"] == 0))).select(
        "g", "region", "sub", F.lit("").alias("chunk"))
    full = chunks.select("g", "region", "sub", F.array_join("p.piece", " ").alias("chunk"))
    return full.unionByName(empty).withColumnRenamed("g", group_col)


def split_regions(df: DataFrame, text_col: str = "text", n_regions: int = 3, unit: str = "word",
                  keep: list[str] | None = None) -> DataFrame:
    """Regions only (no length limit): ``keep + [region, sub=0, chunk]``."""
    return chunk_documents(df, text_col, n_regions, None, unit, keep)


def region_view(chunks: DataFrame, region: int) -> DataFrame:
    """Chunks of one region (a pushed-down filter when chunks are stored partitioned by region)."""
    return chunks.filter(F.col("region") == region)


# Fixed values of the 512-long token windows (BERT-style special ids).
WINDOW_LEN = 512
WINDOW_START_ID = 101
WINDOW_END_ID = 102
WINDOW_PAD_ID = 0


def build_vocabulary(df: DataFrame, text_col: str = "text", first_id: int = 1000) -> DataFrame:
    """Corpus vocabulary ``(term, term_id)``: distinct space tokens in ascending
    order, ids from ``first_id`` (ids below are left for special tokens).
    Numbered by a range-partitioned sort, not a one-task window."""
    terms = df.select(F.explode(F.split(F.col(text_col), " ", -1)).alias("term")).distinct()
    ranked = global_row_number(terms, "term", "rn")
    return ranked.select("term", (F.col("rn") + (first_id - 1)).alias("term_id"))


def cut_windows(docs: pa.Table, ids: pa.Table, body_len: int) -> pa.Table:
    """The windows of a shard's ``docs`` (doc_id, text) with its words' ``ids`` (term, term_id)."""
    words = pc.split_pattern(docs["text"], " ")
    row = np.repeat(np.arange(len(docs)), pc.list_value_length(words).to_numpy())
    at = pc.fill_null(pc.index_in(pc.list_flatten(words), value_set=ids["term"].combine_chunks()), -1).to_numpy()
    row, at = row[at >= 0], at[at >= 0]  # words that the vocabulary lacks are left out
    n = np.bincount(row, minlength=len(docs))
    n_windows = -(-n // body_len)
    doc = np.repeat(np.arange(len(docs)), n_windows)
    first = np.cumsum(n_windows) - n_windows
    pos = np.arange(len(row)) - (np.cumsum(n) - n)[row]
    win = first[row] + pos // body_len
    size = np.bincount(win, minlength=len(doc))
    width = np.maximum(WINDOW_LEN, size + 2)
    column = np.arange(width.max(initial=WINDOW_LEN))
    out = np.full((len(doc), len(column)), WINDOW_PAD_ID, dtype=np.int64)
    out[win, pos % body_len + 1] = ids["term_id"].to_numpy()[at]
    out[:, 0] = WINDOW_START_ID
    out[np.arange(len(doc)), size + 1] = WINDOW_END_ID
    held = column < width[:, None]
    ends = pa.array(np.concatenate([[0], np.cumsum(width)]), pa.int32())
    mask = (column < size[:, None] + 2).astype(np.int32)
    return pa.table([docs["doc_id"].take(pa.array(doc)), pa.array((np.arange(len(doc)) - first[doc]).astype(np.int32)),
                     pa.ListArray.from_arrays(ends, pa.array(out[held])), pa.ListArray.from_arrays(ends, pa.array(mask[held]))],
                    names=["doc_id", "win", "input_ids", "attention_mask"])


def token_windows(df: DataFrame, vocab: DataFrame, text_col: str = "text", doc_col: str = "doc_id",
                  body_len: int = WINDOW_LEN - 2, n_parts: int | None = None) -> DataFrame:
    """Token-id windows ``(doc_id, win, input_ids, attention_mask)``.

    Ids of a document are cut in windows of ``body_len``; each gets the start
    and end id, mask 1, and is right-padded to 512 with id 0 / mask 0.  The texts move once, to ``n_parts``
    shards (a hash of the document).  Only a shard's distinct words meet the vocabulary, and their ids come back to the
    shard, where its texts are cut: a word that many of its documents hold is one row.
    """
    spark = df.sparkSession
    n = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = df.select(F.col(doc_col).alias("doc_id"), F.col(text_col).alias("text"), shard_of(F.col(doc_col), n, spark).alias("shard"))
    docs = store_bucketed(docs.where(F.col("text").isNotNull()), n, ["shard"])
    held = docs.select("shard", F.explode(F.split("text", " ", -1)).alias("term")).distinct()
    # a vocabulary of small counted size is broadcast, otherwise a shuffle join
    ids = held.join(broadcast_if_small(vocab.select("term", F.col("term_id").cast("long").alias("term_id"))), "term")
    ids = ids.select(F.col("shard").alias("shard"), "term", "term_id")
    doc_type = dict(docs.dtypes)["doc_id"]
    return docs.groupBy("shard").cogroup(ids.groupBy("shard")).applyInArrow(
        lambda texts, known: cut_windows(texts, known, body_len),
        f"doc_id {doc_type}, win int, input_ids array<bigint>, attention_mask array<int>")
