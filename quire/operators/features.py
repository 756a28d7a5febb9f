"""Bag-of-terms features per chunk and the corpus vocabulary.

Terms are counted where the chunk's row lies (a sort of numbers for a batch of rows), so the
chunk text is never shuffled.  A term's id is its hash wherever that is one-to-one
(checked), so a chunk's features are made inside its row and no term meets a vocabulary.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.joins import fits_broadcast, measure
from quire.functions.ranking import global_row_number
from quire.functions.text import spaced_terms
from quire.session import store_bucketed

CHUNK_KEY = ["doc_id", "region", "sub"]
# Stored bytes of the feature table per byte of input file, and bytes aimed at per bucket.
EXPANSION, BUCKET_BYTES = 4, 128 * 1024 * 1024


def partitions_for(source: DataFrame) -> int:
    """Bucket count of chunk-keyed tables derived from ``source`` (a file scan): by
    the size of its files, at least the default parallelism, without an upper
    limit.  Only the driver's file listing is used; no job runs."""
    size = int(str(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(source.sparkSession.sparkContext.defaultParallelism, math.ceil(size * EXPANSION / BUCKET_BYTES))


COUNT_BYTES = 8 * 1024 * 1024  # of text that are counted at once


def term_counts(spaced: pa.Array) -> pa.Array:
    """Per text of terms between spaces its distinct terms in ascending order, counted."""
    words = pc.split_pattern(spaced, " ")
    coded = words.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(words)), pc.list_value_length(words).fill_null(0).to_numpy())
    order = pc.array_sort_indices(coded.dictionary)
    place = np.empty(len(order), dtype=np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    place = place[coded.indices.to_numpy()]
    full = pc.not_equal(coded.dictionary, "").to_numpy(zero_copy_only=False)[coded.indices.to_numpy()]
    key, cnt = np.unique(row[full] * len(order) + place[full], return_counts=True)
    row, place = np.divmod(key, max(1, len(order)))
    norm = np.sqrt(np.bincount(row, cnt.astype(float) ** 2, minlength=len(words)))
    terms = coded.dictionary.take(order.take(pa.array(place)))
    runs = pa.StructArray.from_arrays([terms, pa.array(cnt.astype(np.int64)), pa.array(cnt / norm[row])], names=["term", "cnt", "tf"])
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(words)))])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), runs, mask=spaced.is_null())


def counted_terms(spaced: pa.Array) -> pa.Array:
    """``term_counts`` of a batch, ``COUNT_BYTES`` of text at a time."""
    at = np.cumsum(pc.binary_length(spaced).fill_null(0).to_numpy().astype(np.int64)) // COUNT_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(at)) + 1), len(spaced)]
    return pa.concat_arrays([term_counts(spaced[a:b]) for a, b in zip(cuts, cuts[1:])])


def chunk_terms(chunks: DataFrame, text_col: str = "chunk", carry: list[str] | None = None) -> DataFrame:
    """``CHUNK_KEY + carry + [terms]``: per chunk its distinct lower-cased
    letter/digit runs as ``array<struct<term, cnt, tf>>``; ``tf`` is the count
    scaled so a chunk's values have unit L2 norm.  Narrow: row in, row out; the terms of a batch of rows
    are counted together."""
    def work(spaced: pa.Array) -> pa.Array:
        return counted_terms(spaced)

    count = F.arrow_udf(work, "array<struct<term:string,cnt:bigint,tf:double>>")
    return chunks.select(*CHUNK_KEY, *(carry or []), count(spaced_terms(text_col)).alias("terms"))


def term_rows(chunked: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """``CHUNK_KEY + carry + [term, cnt, tf]``, one row per chunk and term."""
    return chunked.select(*CHUNK_KEY, *(carry or []), F.inline("terms"))


def term_vocabulary(rows: DataFrame, counted: Column | None = None) -> DataFrame:
    """``(term, df)``: every term with the number of chunks that hold it (with ``counted``, of such chunks)."""
    return rows.groupBy("term").agg(F.count(F.when(F.lit(True) if counted is None else counted, 1)).alias("df"))


def term_hash(term) -> Column:
    """The id of a term that needs no look-up."""
    return F.xxhash64(term)


def number_terms(vocab: DataFrame) -> DataFrame:
    """Add ``term_id`` (long), different for different terms: the term's 64-bit hash, or, where two terms of
    ``vocab`` share a hash, a dense number (1-based, ascending term order) for all of them."""
    hashed = vocab.withColumn("term_id", term_hash("term").cast("long"))
    if hashed.groupBy("term_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).isEmpty():
        return hashed
    return global_row_number(vocab, "term", "__rn").withColumnRenamed("__rn", "term_id")


def numbered_by_hash(vocab: DataFrame) -> bool:
    return vocab.where(F.col("term_id") != term_hash("term")).isEmpty()


def restrict_to_vocabulary(rows: DataFrame, vocab: DataFrame, size: tuple[int, float] | None = None) -> DataFrame:
    """Keep only vocabulary terms and attach their ``term_id``.  A vocabulary of
    measured small size is broadcast; a larger one is joined by shuffle, where
    adaptive execution splits the hot terms."""
    v = vocab.select("term", "term_id")
    small = fits_broadcast(*(size or measure(v, "term")))
    return rows.join(F.broadcast(v) if small else v, "term", "inner")


def chunk_features(chunked: DataFrame, vocab: DataFrame, carry: list[str], size: tuple[int, float] | None = None,
                   by_hash: bool | None = None) -> DataFrame:
    """``CHUNK_KEY + carry + [feats]``, one row per chunk; ``feats`` is its ``array<struct<term_id, tf>>`` (null
    without a term).  Hash ids are taken inside the row, so no term is moved; a term that ``vocab`` lacks then
    keeps an id that no parameter has.  Other ids are joined, and unknown terms are left out."""
    if numbered_by_hash(vocab) if by_hash is None else by_hash:
        feats = F.transform("terms", lambda t: F.struct(term_hash(t["term"]).cast("long").alias("term_id"), t["tf"].alias("tf")))
        return chunked.select(*CHUNK_KEY, *carry, F.when(F.size(feats) > 0, feats).alias("feats"))
    known = restrict_to_vocabulary(term_rows(chunked), vocab, size)
    # a chunk's terms are bounded by its own text
    feats = known.groupBy(*CHUNK_KEY).agg(F.collect_list(F.struct("term_id", "tf")).alias("feats"))
    return chunked.select(*CHUNK_KEY, *carry).join(feats, CHUNK_KEY, "left")


def feature_store(chunked: DataFrame, vocab: DataFrame, n: int, carry: list[str], size: tuple[int, float] | None = None,
                  partition_by: tuple[str, ...] = (), key: list[str] | None = None) -> DataFrame:
    """The stored training table, one row per chunk (see ``chunk_features``), bucketed on the chunk key, or on
    ``key`` (of ``carry``)."""
    return store_bucketed(chunk_features(chunked, vocab, carry, size), n, key or CHUNK_KEY, partition_by)


DEALT = 4096  # shards that are dealt one to a bucket


def shard_of(key: Column, n: int, spark: SparkSession) -> Column:
    """The shard of ``key``: a hash of it into ``n`` numbers, chosen so that a table bucketed on the shard has one
    shard in each of ``n`` buckets.  Beyond ``DEALT`` shards they are plain numbers, several in some buckets."""
    at = F.pmod(F.xxhash64(key), F.lit(n))
    if n > DEALT:
        return at
    bucket = F.pmod(F.hash("id"), F.lit(n))
    first = {r.b: r.id for r in spark.range(40 * n + 400).groupBy(bucket.alias("b")).agg(F.min("id").alias("id")).collect()}  # n rows
    # a bucket that none of the numbers falls in gets a number of its own all the same
    numbers = [first.get(b, -1 - b) for b in range(n)]
    return F.get(F.array(*[F.lit(x).cast("long") for x in numbers]), at.cast("int"))
