"""Scoring chunks and rolling chunk scores up to one prediction per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.arrays import argmax_first, names
from quire.operators.metrics import metrics
from quire.operators.train import by_key, chunk_logits, shard_logits, shard_store, with_probs


def score_chunks(chunks: DataFrame, params: DataFrame, k: int, body_rows: int | None = None, n_parts: int | None = None) -> DataFrame:
    """Raw class scores ``l_0..l_{k-1}`` per chunk (chunks with no known term keep their row).  With ``n_parts``
    the chunks' shards get the weights of their own terms; without, all weights are joined."""
    if n_parts is None:
        return chunk_logits(chunks, params, k, body_rows)
    return shard_logits(by_key(params, n_parts), shard_store(chunks, n_parts), k)


def chunk_softmax(logits: DataFrame, k: int) -> DataFrame:
    return with_probs(logits, k)


def doc_mean_probs(probs: DataFrame, k: int, doc_col: str = "doc_id") -> DataFrame:
    """Mean of each class probability over a document's chunks (partial
    aggregation: a document with many chunks combines map-side)."""
    return probs.groupBy(doc_col).agg(*[F.avg(p).alias(p) for p in names("p", k)])


def doc_argmax(doc_probs: DataFrame, k: int, out: str = "prediction_idx") -> DataFrame:
    """Index of the largest mean probability; the first class wins a tie."""
    return doc_probs.withColumn(out, argmax_first([F.col(p) for p in names("p", k)]))


def attach_gold(docs: DataFrame, gold: DataFrame, doc_col: str = "doc_id", gold_col: str = "label",
                out: str = "gold", order_col: str | None = None) -> DataFrame:
    """Look up each document's raw label (inner equi-join on the document id).

    Where gold holds an id several times the first match counts: the row with the smallest ``order_col`` (and
    of equal ones the smallest label), or without one the smallest label.  The choice is a partial
    aggregation before the join, so a document is never multiplied, however often its id occurs."""
    place = F.struct(*[F.col(c) for c in ([order_col] if order_col else [])], F.col(gold_col))
    g = gold.groupBy(doc_col).agg(F.min_by(F.struct(F.col(gold_col).alias("label")), place)["label"].alias(out))
    return docs.join(g, doc_col, "inner")


# Fixed value: what an integer literal may look like (surrounding whitespace,
# optional sign, digits with single underscores between them).
INT_TEXT = r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$"


def parse_generated(df: DataFrame, text_col: str = "generated", out: str = "prediction") -> DataFrame:
    """Generated label text to an integer; rows whose text is not an integer
    literal (words, decimals such as ``1.0`` or ``3.``) are dropped."""
    txt = F.col(text_col)
    clean = F.regexp_replace(F.regexp_replace(txt, r"^\s+|\s+$", ""), "_", "")
    parsed = F.when(txt.rlike(INT_TEXT), F.expr("try_cast(__clean AS BIGINT)"))
    return (df.withColumn("__clean", clean).withColumn(out, parsed).drop("__clean")
            .filter(F.col(out).isNotNull()))


def doc_max_vote(df: DataFrame, doc_col: str = "doc_id", pred_col: str = "prediction") -> DataFrame:
    """Largest predicted label per document; documents with no valid row are absent."""
    return df.groupBy(doc_col).agg(F.max(pred_col).alias(pred_col))


def label_voting(answers: DataFrame, gold: DataFrame, text_col: str = "generated", doc_col: str = "doc_id",
                 gold_col: str = "gold") -> DataFrame:
    """Several generated answers per document to metrics: answers that are no integer
    are dropped, the largest one wins, documents without a valid answer or a gold
    label are left out."""
    votes = doc_max_vote(parse_generated(answers, text_col), doc_col)
    return metrics(votes.join(gold.select(doc_col, F.col(gold_col).alias("gold")), doc_col), "gold", "prediction")


def binary_threshold(p0: Column | str, p1: Column | str) -> Column:
    """Class 1 when ``p0 <= p1`` (a tie goes to class 1)."""
    p0 = F.col(p0) if isinstance(p0, str) else p0
    p1 = F.col(p1) if isinstance(p1, str) else p1
    return F.when(p0 <= p1, 1).otherwise(0).cast("int")
