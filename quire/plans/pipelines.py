"""End-to-end plans composed from the operators.

``FusedPlan`` is the main chain: split -> label map -> encode -> regions and
chunks -> term features -> one model per region (all trained in the same
jobs) -> parameter averaging into a base model -> further training on the
finetune split -> chunk scores -> document roll-up -> gold -> metrics.  Each
stage is built once and reused; action boundaries are the split cuts, the
label map, the vocabulary, and one checkpoint per training epoch.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.chunking import chunk_documents
from quire.operators.encoding import decode_labels, encode_labels, fit_label_map
from quire.operators.features import (CHUNK_KEY, chunk_features, chunk_terms, feature_store, number_terms, numbered_by_hash, partitions_for,
                                      shard_of, term_rows, term_vocabulary)
from quire.operators.metrics import metrics
from quire.operators.params import FUSED_ID, fuse_models
from quire.operators.score import attach_gold, chunk_softmax, doc_argmax, doc_mean_probs, score_chunks
from quire.operators.splits import split_recipe
from quire.operators.train import SHARD_ROWS, BatchFit, FitResult, fit, fit_batches, fit_local, init_params
from quire.functions.joins import measure
from quire.session import cut_lineage, store_bucketed


@dataclass(frozen=True)
class FusedConfig:
    label_col: str = "lang"
    recipe: str = "news"
    n_regions: int = 3
    max_tokens: int | None = 400
    unit: str = "word"
    epochs: int = 3
    lr: float = 8.0
    finetune_epochs: int = 3
    finetune_lr: float = 8.0
    batches: int = 4
    batch_lr: float = 0.3
    shard_rows: int = SHARD_ROWS
    eval_every: int = 2
    seed: int = 777
    weights: tuple | None = None
    apply_first_weight: bool = False


class FusedPlan:
    """Lazily built stages of the fused pipeline over a ``(doc_id, text, <label_col>)`` corpus."""

    def __init__(self, docs: DataFrame, cfg: FusedConfig = FusedConfig(), n_parts: int | None = None):
        """``n_parts``: partition count of the chunk-keyed tables; by default
        derived from ``docs``, which should then be a plain file scan (pass it
        explicitly when ``docs`` is itself a join)."""
        self.cfg = cfg
        self.docs = docs.select("doc_id", "text", F.col(cfg.label_col).alias("label"))
        self.n_parts = n_parts or partitions_for(docs)

    # -- corpus -----------------------------------------------------------
    @cached_property
    def split_docs(self) -> DataFrame:
        return split_recipe(self.docs, self.cfg.recipe, self.cfg.seed)

    @cached_property
    def label_map(self) -> DataFrame:
        return cut_lineage(fit_label_map(self.split_docs.filter(F.col("split") == "train"), "label"))

    @cached_property
    def k(self) -> int:
        return self.label_map.count()

    @cached_property
    def encoded(self) -> DataFrame:
        """The split corpus with ``label_idx`` (null for labels that train lacks)."""
        return encode_labels(self.split_docs, self.label_map, "label", "label_idx", self.k)

    @property
    def encoded_for_training(self) -> DataFrame:
        """Test rows keep their raw label only (their index is not used)."""
        return self.encoded.withColumn(
            "label_idx", F.when(F.col("split") == "test", F.lit(None)).otherwise(F.col("label_idx")))

    def cut(self, docs: DataFrame, carry: list[str]) -> DataFrame:
        return chunk_documents(docs, "text", self.cfg.n_regions, self.cfg.max_tokens, self.cfg.unit,
                               keep=["doc_id", "split", "label", "label_idx", *carry])

    @cached_property
    def chunks(self) -> DataFrame:
        """``doc_id, region, sub, split, label, label_idx, chunk``: a narrow view, computed from the corpus when read."""
        return self.cut(self.encoded_for_training, [])

    @cached_property
    def terms(self) -> DataFrame:
        """The one pass over the text: each chunk's keys, labels and counted terms, stored by shard (a hash of the
        document) and split.  The text moves to its shard once, before it is cut; its terms stay there."""
        shard = shard_of(F.col("doc_id"), self.n_parts, self.docs.sparkSession)
        dealt = self.encoded_for_training.withColumn("shard", shard).repartition(self.n_parts, "shard")
        return store_bucketed(chunk_terms(self.cut(dealt, ["shard"]), carry=["shard", "split", "label", "label_idx"]),
                              self.n_parts, ["shard"], ("split",), dealt=True)

    @cached_property
    def dictionary(self) -> DataFrame:
        """``term, df, term_id``: every term of the corpus, with the train chunks that hold it."""
        counted = term_vocabulary(term_rows(self.terms, ["split"]), F.col("split") == "train")
        return number_terms(cut_lineage(counted))

    @property
    def vocab(self) -> DataFrame:
        """Every term of the train chunks; a term that train lacks has no parameter."""
        return self.dictionary.filter(F.col("df") > 0)

    @cached_property
    def vocab_size(self) -> tuple[int, float]:
        return measure(self.vocab.select("term", "term_id"), "term")

    @property
    def vocab_rows(self) -> int:
        return self.vocab_size[0]

    @cached_property
    def features(self) -> DataFrame:
        """``doc_id, region, sub, label_idx, feats, split``: one row per chunk, bucketed on its key,
        one folder per split.  For readers that join chunks by key; training reads ``dealt``."""
        return feature_store(self.terms, self.dictionary, self.n_parts, ["label_idx", "split"], self.vocab_size, ("split",))

    def samples(self, split: str, model: Column) -> DataFrame:
        return (self.features.filter(F.col("split") == split)
                .select(*CHUNK_KEY, model.cast("int").alias("model_id"), "label_idx", "feats"))

    @cached_property
    def shard_features(self) -> DataFrame:
        """``features`` by shard: hash ids are made where the terms lie, others are stored."""
        carry = ["shard", "label_idx", "split"]
        if numbered_by_hash(self.dictionary):
            return chunk_features(self.terms, self.dictionary, carry, by_hash=True)
        return feature_store(self.terms, self.dictionary, self.n_parts, carry, self.vocab_size, ("split",), ["shard"])

    def dealt(self, split: str, model: Column) -> DataFrame:
        """The split's samples by shard."""
        return (self.shard_features.filter(F.col("split") == split)
                .select("shard", *CHUNK_KEY, model.cast("int").alias("model_id"), "label_idx", "feats"))

    # -- models -----------------------------------------------------------
    @cached_property
    def region_fit(self) -> FitResult:
        c = self.cfg
        region = F.col("region")
        init = init_params(self.vocab, list(range(c.n_regions)), self.k)
        return fit(init, self.dealt("train", region), self.k, c.lr, c.epochs, self.dealt("dev", region),
                   body_rows=self.vocab_rows * c.n_regions, n_parts=self.n_parts)

    @cached_property
    def batch_fit(self) -> BatchFit:
        """The region models by mini-batch steps, evaluated at step numbers."""
        c = self.cfg
        region = F.col("region")
        init = init_params(self.vocab, list(range(c.n_regions)), self.k)
        return fit_batches(init, self.dealt("train", region), self.k, c.batch_lr, c.epochs, c.batches, self.dealt("dev", region),
                           c.eval_every, self.n_parts, self.vocab_rows * c.n_regions, c.seed)

    @cached_property
    def local_fit(self) -> BatchFit:
        """The region models by steps inside shards, averaged after every round."""
        c = self.cfg
        region = F.col("region")
        init = init_params(self.vocab, list(range(c.n_regions)), self.k)
        return fit_local(init, self.dealt("train", region), self.k, c.lr, c.epochs, c.batches, self.dealt("dev", region),
                         self.n_parts, self.vocab_rows * c.n_regions, c.shard_rows, c.seed)

    @cached_property
    def base(self) -> DataFrame:
        return init_params(self.vocab, [FUSED_ID], self.k)

    @cached_property
    def fused(self) -> DataFrame:
        c = self.cfg
        return cut_lineage(fuse_models(self.base, self.region_fit.params, self.k,
                                       weights=list(c.weights) if c.weights else None,
                                       apply_first_weight=c.apply_first_weight))

    @cached_property
    def finetune_fit(self) -> FitResult:
        c = self.cfg
        one = F.lit(FUSED_ID)
        return fit(self.fused, self.dealt("finetune", one), self.k, c.finetune_lr, c.finetune_epochs,
                   self.dealt("dev", one), body_rows=self.vocab_rows, n_parts=self.n_parts)

    # -- prediction -------------------------------------------------------
    def chunk_scores(self, params: DataFrame | None = None) -> DataFrame:
        p = self.finetune_fit.params if params is None else params
        return score_chunks(self.dealt("test", F.lit(FUSED_ID)), p, self.k, self.vocab_rows, self.n_parts)

    def chunk_probs(self, params: DataFrame | None = None) -> DataFrame:
        return chunk_softmax(self.chunk_scores(params), self.k)

    def doc_probs(self, params: DataFrame | None = None) -> DataFrame:
        return doc_mean_probs(self.chunk_probs(params), self.k)

    def doc_predictions(self, params: DataFrame | None = None) -> DataFrame:
        docs = doc_argmax(self.doc_probs(params), self.k)
        return decode_labels(docs, self.label_map, "prediction_idx", "prediction", self.k)

    def with_gold(self, params: DataFrame | None = None) -> DataFrame:
        return attach_gold(self.doc_predictions(params), self.split_docs.filter(F.col("split") == "test"),
                           gold_col="label")

    def metrics(self, params: DataFrame | None = None) -> DataFrame:
        return metrics(cut_lineage(self.with_gold(params).select("gold", "prediction")), "gold", "prediction")


def fuse_stored(spark, models_path: str, base_path: str | None, vocab: DataFrame, k: int,
                model_ids: list[int] | None = None, weights=None, apply_first_weight: bool = False) -> DataFrame:
    """Fuse parameter tables stored with ``write_params`` without any training:
    average the stored models' bodies into the stored base model (or, without
    one, an all-zero base over ``vocab``)."""
    from quire.operators.params import read_params

    models = read_params(spark, models_path, model_ids)
    base = read_params(spark, base_path) if base_path else init_params(vocab, [FUSED_ID], k)
    return fuse_models(base, models, k, weights=weights, apply_first_weight=apply_first_weight)
