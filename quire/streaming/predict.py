"""Scoring a stream of incoming documents with a stored model.

Chunking and scoring are stateless per document, so each micro-batch is
scored with the same batch operators (``foreachBatch``); a document never
spans micro-batches, which makes the per-document roll-up exact.  Output is
written per batch id with overwrite, so a retried batch replaces its own
folder instead of appending twice.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.arrays import names
from quire.functions.joins import broadcast_if_small, measure
from quire.operators.chunking import chunk_documents
from quire.operators.encoding import decode_labels
from quire.operators.features import CHUNK_KEY, chunk_terms
from quire.operators.params import FUSED_ID
from quire.operators.score import chunk_softmax, doc_argmax, doc_mean_probs


def score_documents(docs: DataFrame, params: DataFrame, label_map: DataFrame, k: int, n_regions: int = 3,
                    max_tokens: int | None = 400, unit: str = "word", model_id: int = FUSED_ID,
                    size: tuple[int, float] | None = None) -> DataFrame:
    """``(doc_id, p_0..p_{k-1}, prediction_idx, prediction)`` for a batch of ``(doc_id, text)`` rows.

    The batch is read once: a chunk's terms and the constant of the head are rows that meet the
    parameters by name, so a chunk without a known term keeps the head's row.  ``size`` is the
    parameters' (rows, bytes per row) where the caller has measured them."""
    chunked = chunk_terms(chunk_documents(docs, "text", n_regions, max_tokens, unit, keep=["doc_id"]))
    head = F.array(F.struct(F.lit("head").alias("part"), F.lit("bias").alias("param"), F.lit(1.0).alias("tf")))
    body = F.transform("terms", lambda t: F.struct(F.lit("body").alias("part"), t["term"].alias("param"), t["tf"].alias("tf")))
    rows = chunked.select(*CHUNK_KEY, F.inline(F.concat(head, body)))
    w = params.filter(F.col("model_id") == model_id).select("part", "param", *names("w", k))
    w = broadcast_if_small(w, *(size or (None, None)))
    logits = rows.join(w, ["part", "param"]).groupBy(*CHUNK_KEY).agg(
        *[F.sum(F.col("tf") * F.col(c)).alias(l) for c, l in zip(names("w", k), names("l", k))])
    docs_p = doc_argmax(doc_mean_probs(chunk_softmax(logits, k), k), k)
    return decode_labels(docs_p, label_map, "prediction_idx", "prediction", k)


def start_prediction_stream(stream: DataFrame, params: DataFrame, label_map: DataFrame, k: int, sink: str,
                            checkpoint: str, n_regions: int = 3, max_tokens: int | None = 400,
                            available_now: bool = True):
    """Start a streaming query scoring every new document of ``stream``
    (``doc_id, text``); results land in ``<sink>/batch=<id>``."""
    size = measure(params, "part", "param")

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        out = score_documents(batch, params, label_map, k, n_regions, max_tokens, size=size)
        out.write.mode("overwrite").parquet(os.path.join(sink, f"batch={batch_id}"))

    w = stream.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
