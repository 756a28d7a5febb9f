"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

Every query reads the driver tables (or frames Spark derives from them) in
full.  Pipeline-backed queries share one :class:`FusedPlan` per (session, data
folder, configuration), so the split, chunk, feature and training stages run
once per session however many of them are requested.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.arrays import names
from quire.functions.joins import broadcast_if_small
from quire.operators.features import partitions_for, restrict_to_vocabulary, term_rows
from quire.functions.text import char_tokens, flatten_whitespace, word_tokens
from quire.operators import labels as L
from quire.operators import stats as S
from quire.operators.chunking import build_vocabulary, chunk_documents, chunk_paragraphs, region_view, token_windows
from quire.operators.encoding import decode_labels, sorted_encoder
from quire.operators.metrics import confusion, fold_summary, metrics, per_label
from quire.operators.params import FUSED_ID, average_blocks, average_models, check_compatible, from_blocks, fuse_models, to_blocks
from quire.operators.score import attach_gold, binary_threshold, doc_max_vote, label_voting, parse_generated
from quire.operators.splits import exact_split, hash_bucket, hash_split, split_recipe
from quire.operators.training_sets import TASK_NAME, prediction_prompt, prompt_rows, region_training_set, union_regions
from quire.operators.train import fit, init_params
from quire.plans import corpora
from quire.plans.pipelines import FusedConfig, FusedPlan
from quire.session import cut_lineage, table

R = 6  # decimals kept for floating results

# Configuration of the registered pipeline queries (fixed values).
PIPE_CFG = FusedConfig(label_col="lang", recipe="news", n_regions=3, max_tokens=400,
                       epochs=2, lr=8.0, finetune_epochs=2, finetune_lr=8.0)
BASELINE_CFG = FusedConfig(label_col="lang", recipe="news", n_regions=1, max_tokens=None,
                           epochs=2, lr=8.0, finetune_epochs=0, finetune_lr=8.0)
BINARY_CFG = FusedConfig(label_col="quality", recipe="news", n_regions=3, max_tokens=400,
                         epochs=2, lr=8.0, finetune_epochs=2, finetune_lr=8.0)
N_FOLDS = 5

_PLANS: dict = {}


def _plan(spark: SparkSession, sf_dir: str, cfg: FusedConfig, corpus: str = "documents") -> FusedPlan:
    """One plan per application, configuration and state of the input files: when the files
    change, so do their names, their total size or the time of the last write, and a new plan is built."""
    docs = table(spark, sf_dir, "documents")
    files = hashlib.sha256("\n".join(sorted(docs.inputFiles())).encode()).hexdigest()
    size = str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    written = docs.agg(F.max("_metadata.file_modification_time")).first()[0]  # reads no column
    key = (spark.sparkContext.applicationId, files, size, written, cfg, corpus)
    plan = _PLANS.get(key)
    if plan is None or plan.docs.sparkSession is not spark:
        n_parts = partitions_for(docs)
        if corpus == "labelled":
            docs = docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
        plan = _PLANS[key] = FusedPlan(docs, cfg, n_parts)
    return plan


def _r(c: str):
    return F.round(F.col(c), R).alias(c)


def _round_all(df: DataFrame, cols) -> DataFrame:
    cols = set(cols)
    return df.select(*[_r(c) if c in cols else F.col(c) for c in df.columns])


def _k_cols(prefix: str, k: int) -> list[str]:
    return names(prefix, k)


# -- statistics and label rules ------------------------------------------------------------------

def q_length_bands(spark, d):
    return _round_all(S.length_bands(table(spark, d, "documents")), ["pct_below", "pct_between", "pct_above"])


def _role_sizes(spark, d) -> DataFrame:
    conv = table(spark, d, "conversations")
    return conv.groupBy("conv_id").agg(
        *[F.sum(F.when(F.col("role") == r, 1).otherwise(0)).alias(f"n_{r}") for r in ("user", "assistant", "system", "tool")])


def q_class_counts_any(spark, d):
    s = _role_sizes(spark, d)
    return S.class_counts(s.select(L.label_any_nonempty("n_system", "n_tool").alias("label")))


def q_class_counts_all(spark, d):
    s = _role_sizes(spark, d)
    return S.class_counts(s.select(L.label_all_nonempty("n_user", "n_assistant", "n_system").alias("label")))


def q_rationale_label(spark, d):
    s = _role_sizes(spark, d)
    return s.select("conv_id", L.label_from_rationales("n_assistant").alias("labels"))


def q_rename_cast_label(spark, d):
    return L.rename_cast_label(table(spark, d, "labels").select("doc_id", "quality"), "quality", "labels", "string")


def q_flatten_whitespace(spark, d):
    return table(spark, d, "documents").select("doc_id", flatten_whitespace("text").alias("text"))


def q_paragraph_words(spark, d):
    # Joining a conversation's turns with one space and splitting on spaces gives
    # the concatenation of each turn's tokens, so the counts add up per turn and
    # no conversation is ever gathered into one row.
    conv = table(spark, d, "conversations")
    toks = word_tokens("text")
    return conv.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_paragraphs"),
        F.sum(F.size(toks)).cast("long").alias("n_words"),
        F.sum(F.size(F.filter(toks, lambda t: t == ""))).cast("long").alias("n_empty"))


def q_char_chunks(spark, d):
    return chunk_documents(table(spark, d, "benchmark"), "text", 3, 400, "char", keep=["item_id"])


def q_chunk_histogram(spark, d):
    return S.chunk_histogram(table(spark, d, "documents"), "text", 510)


def q_long_doc_counts(spark, d):
    return S.long_doc_counts(table(spark, d, "documents"))


def q_conclusion_label(spark, d):
    docs = table(spark, d, "documents")
    return S.class_counts(docs.select(L.label_from_conclusion("source", "SRC0").alias("label")))


# -- splits and label map ------------------------------------------------------------------

def q_hash_split(spark, d):
    return hash_split(table(spark, d, "documents").select("doc_id"), 0.2)


def q_exact_split(spark, d):
    return exact_split(table(spark, d, "documents").select("doc_id"), 0.2)


def _recipe(name):
    def q(spark, d):
        return split_recipe(table(spark, d, "documents").select("doc_id"), name).select("doc_id", "split")
    return q


def q_label_map(spark, d):
    return _plan(spark, d, PIPE_CFG).label_map


def q_encode_labels(spark, d):
    p = _plan(spark, d, PIPE_CFG)
    idx = F.when(F.col("split") == "test", F.lit(None)).otherwise(F.col("label_idx"))
    return p.encoded.select("doc_id", "split", "label", idx.alias("label_idx"))


def q_decode_labels(spark, d):
    p = _plan(spark, d, PIPE_CFG)
    enc = q_encode_labels(spark, d)
    return decode_labels(enc, p.label_map, "label_idx", "decoded", p.k)


def q_sorted_encoder(spark, d):
    enc, _ = sorted_encoder(table(spark, d, "documents").select("doc_id", "source"), "source", "label_idx")
    return enc


# -- chunking and training sets ------------------------------------------------------------------

def _doc_chunks(spark, d, only_region=None):
    docs = table(spark, d, "documents").select("doc_id", "text", F.col("lang").alias("label"))
    return chunk_documents(docs, "text", 3, 400, "word", keep=["doc_id", "label"], only_region=only_region)


def q_region_chunks(spark, d):
    return _doc_chunks(spark, d)


def q_region_view(spark, d):
    return region_view(_doc_chunks(spark, d, 1), 1)


def q_token_windows(spark, d):
    docs = table(spark, d, "documents")
    return token_windows(docs, cut_lineage(build_vocabulary(docs)), n_parts=partitions_for(docs))


def q_region_training_set(spark, d):
    return region_training_set(_plan(spark, d, PIPE_CFG).chunks, 0)


def q_union_regions(spark, d):
    return union_regions(_plan(spark, d, PIPE_CFG).chunks, "finetune")


def q_prompt_rows(spark, d):
    return prompt_rows(region_training_set(_plan(spark, d, PIPE_CFG).chunks, 0, ("train",)))


def q_term_features(spark, d):
    p = _plan(spark, d, PIPE_CFG)
    # the vocabulary is that of the train chunks, so only the other splits' terms are looked up
    train, other = (term_rows(p.terms.filter(c)) for c in (F.col("split") == "train", F.col("split") != "train"))
    f = train.unionByName(restrict_to_vocabulary(other, p.vocab, p.vocab_size).select(*train.columns))
    return _round_all(f.select("doc_id", "region", "sub", "term", "cnt", "tf"), ["tf"])


# -- models ------------------------------------------------------------------

def _params_out(params: DataFrame, k: int) -> DataFrame:
    return _round_all(params.select("model_id", "part", "param", *_k_cols("w", k)), _k_cols("w", k))


def q_fit_region_models(spark, d):
    p = _plan(spark, d, PIPE_CFG)
    return _params_out(p.region_fit.params, p.k)


def q_best_epoch(spark, d):
    return _round_all(_plan(spark, d, PIPE_CFG).region_fit.history, ["dev_loss"])


def q_fit_batches(spark, d):
    p = _plan(spark, d, PIPE_CFG)
    return _params_out(p.batch_fit.params, p.k)


def q_best_step(spark, d):
    return _round_all(_plan(spark, d, PIPE_CFG).batch_fit.history, ["dev_loss"])


def q_fit_local(spark, d):
    p = _plan(spark, d, PIPE_CFG)
    return _params_out(p.local_fit.params, p.k)


def q_best_round(spark, d):
    return _round_all(_plan(spark, d, PIPE_CFG).local_fit.history, ["dev_loss"])


def _embedding_params(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("model_id"), "label",
                    F.posexplode("embedding").alias("pos", "value")).withColumn("value", F.col("value").cast("double"))


def q_average_models(spark, d):
    models = table(spark, d, "embeddings").select("label", F.col("vec_id").alias("model_id"))
    avg = average_models(_embedding_params(spark, d), ["pos"], ["value"], group_cols=["label"], models=models)
    return _round_all(avg, ["value"])


def q_weighted_average(spark, d):
    e = table(spark, d, "embeddings")
    weights = e.select(F.col("vec_id").alias("model_id"), (1.0 + F.col("vec_id") % 3).alias("weight"))
    avg = average_models(_embedding_params(spark, d), ["pos"], ["value"], group_cols=["label"], weights=weights,
                         models=e.select("label", F.col("vec_id").alias("model_id")))
    return _round_all(avg, ["value"])


def q_fuse_into(spark, d):
    p = _plan(spark, d, PIPE_CFG)
    return _params_out(p.fused, p.k)


def q_check_compatible(spark, d):
    # region models as if each kept only the terms its own training chunks saw
    p = _plan(spark, d, PIPE_CFG)
    train = p.dealt("train", F.col("region")).filter(F.col("doc_id").isNotNull())
    local = train.select("model_id", F.lit("body").alias("part"), F.explode("feats.term_id").alias("param_id")).distinct()
    bad = check_compatible(local, ["part", "param_id"])
    v = broadcast_if_small(p.vocab.select(F.col("term_id").alias("param_id"), F.col("term").alias("param")), *p.vocab_size)
    return bad.join(v, "param_id").select("part", "param", "n_models", "n_with_key")


def q_finetune_step(spark, d):
    p = _plan(spark, d, PIPE_CFG)
    return _params_out(p.finetune_fit.params, p.k)


# -- scoring ------------------------------------------------------------------

def q_chunk_scores(spark, d):
    p = _plan(spark, d, PIPE_CFG)
    return _round_all(p.chunk_scores().drop("model_id"), _k_cols("l", p.k))


def q_chunk_softmax(spark, d):
    p = _plan(spark, d, PIPE_CFG)
    return _round_all(p.chunk_probs().drop("model_id"), _k_cols("p", p.k))


def q_doc_mean_probs(spark, d):
    p = _plan(spark, d, PIPE_CFG)
    return _round_all(p.doc_probs(), _k_cols("p", p.k))


def q_doc_argmax(spark, d):
    p = _plan(spark, d, PIPE_CFG)
    from quire.operators.score import doc_argmax
    return _round_all(doc_argmax(p.doc_probs(), p.k), _k_cols("p", p.k))


def q_doc_predictions(spark, d):
    p = _plan(spark, d, PIPE_CFG)
    return _round_all(p.doc_predictions(), _k_cols("p", p.k))


def q_attach_gold(spark, d):
    p = _plan(spark, d, PIPE_CFG)
    return _round_all(p.with_gold(), _k_cols("p", p.k))


def _generated(spark, d) -> DataFrame:
    """Stand-in for generated label text (the generator is not part of this
    library): each word of a test chunk counts as one sampled answer to the
    prompt ``task:chunk``."""
    p = _plan(spark, d, PIPE_CFG)
    test = p.chunks.filter(F.col("split") == "test")
    return test.select("doc_id", "region", "sub", prediction_prompt("chunk").alias("prompt"),
                       F.posexplode(word_tokens("chunk")).alias("sample", "generated"))


def q_parse_generated(spark, d):
    return parse_generated(_generated(spark, d)).select("doc_id", "region", "sub", "sample", "prediction")


def q_doc_max_vote(spark, d):
    return doc_max_vote(parse_generated(_generated(spark, d)))


def q_binary_threshold(spark, d):
    p = _plan(spark, d, BINARY_CFG, "labelled")
    probs = p.doc_probs()
    return _round_all(probs.select("doc_id", "p_0", "p_1", binary_threshold("p_0", "p_1").alias("prediction")),
                      ["p_0", "p_1"])


# -- metrics ------------------------------------------------------------------

_MET = ["accuracy", "weighted_precision", "weighted_recall", "weighted_f1", "macro_f1", "micro_f1"]


def q_metrics(spark, d):
    return _round_all(_plan(spark, d, PIPE_CFG).metrics(), _MET)


def q_per_label_report(spark, d):
    g = _plan(spark, d, PIPE_CFG).with_gold()
    return _round_all(per_label(confusion(g, "gold", "prediction")), ["precision", "recall", "f1"])


def q_fold_summary(spark, d):
    g = _plan(spark, d, PIPE_CFG).with_gold().withColumn("fold", hash_bucket("doc_id", 777, N_FOLDS))
    per_fold = metrics(g, "gold", "prediction", ["fold"])
    return _round_all(fold_summary(per_fold), ["mean", "std"])


# -- pipelines ------------------------------------------------------------------

def q_fused_documents(spark, d):
    return _plan(spark, d, PIPE_CFG).with_gold().select("doc_id", "prediction", "gold")


def q_fuse_only_metrics(spark, d):
    p = _plan(spark, d, PIPE_CFG)
    return _round_all(p.metrics(p.fused), _MET)


def q_baseline_metrics(spark, d):
    p = _plan(spark, d, BASELINE_CFG)
    return _round_all(p.metrics(p.region_fit.params.withColumn("model_id", F.lit(FUSED_ID))), _MET)


def q_baseline_docs(spark, d):
    p = _plan(spark, d, BASELINE_CFG)
    return p.with_gold(p.region_fit.params.withColumn("model_id", F.lit(FUSED_ID))).select("doc_id", "prediction", "gold")


def q_untrained_docs(spark, d):
    p = _plan(spark, d, BASELINE_CFG)
    return p.with_gold(p.base).select("doc_id", "prediction", "gold")


def q_untrained_metrics(spark, d):
    p = _plan(spark, d, BASELINE_CFG)
    return _round_all(p.metrics(p.base), _MET)


def _answers(spark, d) -> DataFrame:
    """Answers to vote on, derived from both labels of each document: as they stand, padded,
    signed, and some that are no integer; documents marked toxic give no valid answer for quality."""
    q, t = F.col("quality").cast("string"), F.col("toxic").cast("string")
    told = F.array(F.when(F.col("toxic") == 0, F.concat(F.lit(" "), q)).otherwise(F.concat(q, F.lit(".0"))),
                   F.concat(F.lit("+"), t), F.lit("label"), F.concat(q, F.lit(" of "), t))
    return table(spark, d, "labels").select("doc_id", F.posexplode(told).alias("sample", "generated"))


def q_vote_metrics(spark, d):
    gold = table(spark, d, "labels").select("doc_id", F.col("quality").alias("gold"))
    return _round_all(label_voting(_answers(spark, d), gold), _MET)


def q_paragraph_chunks(spark, d):
    conv = table(spark, d, "conversations")
    return chunk_paragraphs(conv, "conv_id", "turn", "text", 3, 400)


def q_fuse_stored(spark, d):
    """Model fusing over parameter tables: every embedding label is one stored model."""
    e = table(spark, d, "embeddings").select(
        F.col("label").cast("int").alias("model_id"), F.lit("body").alias("part"), F.posexplode("embedding").alias("param_id", "w_0"))
    models = e.groupBy("model_id", "part", "param_id").agg(F.avg(F.col("w_0").cast("double")).alias("w_0"))
    models = models.withColumn("param", F.col("param_id").cast("string"))
    base = models.filter(F.col("model_id") == 0).withColumn("w_0", F.lit(0.0))
    return _round_all(fuse_models(base, models, 1).select("model_id", "part", "param", "w_0"), ["w_0"])


def q_attach_gold_first(spark, d):
    """Gold with repeated ids: every turn of a conversation is a match, the first turn counts."""
    turns = table(spark, d, "conversations")
    return attach_gold(turns.select("conv_id").distinct(), turns, "conv_id", "role", order_col="turn")


def q_average_blocks(spark, d):
    """Every embedding is one model's tensor, averaged per label in blocks of 24 values."""
    e = table(spark, d, "embeddings").select("label", F.col("vec_id").alias("model_id"), "embedding")
    avg = average_blocks(to_blocks(e, "embedding", ["label", "model_id"], 24), group_cols=["label"],
                         models=e.select("label", "model_id"), block=24)
    return _round_all(from_blocks(avg, ["label"], 24), ["value"])


def q_prediction_prompts(spark, d):
    test = _plan(spark, d, PIPE_CFG).chunks.filter(F.col("split") == "test")
    return test.select("doc_id", "region", "sub", prediction_prompt("chunk").alias("prompt"))


QUERIES = {
    "length_bands": q_length_bands,
    "class_counts_any": q_class_counts_any,
    "class_counts_all": q_class_counts_all,
    "rationale_label": q_rationale_label,
    "rename_cast_label": q_rename_cast_label,
    "flatten_whitespace": q_flatten_whitespace,
    "paragraph_words": q_paragraph_words,
    "char_chunks": q_char_chunks,
    "chunk_histogram": q_chunk_histogram,
    "long_doc_counts": q_long_doc_counts,
    "conclusion_label": q_conclusion_label,
    "hash_split": q_hash_split,
    "exact_split": q_exact_split,
    "recipe_news": _recipe("news"),
    "recipe_cases": _recipe("cases"),
    "recipe_crisis": _recipe("crisis"),
    "recipe_paragraph": _recipe("paragraph"),
    "recipe_flagged": _recipe("flagged"),
    "label_map": q_label_map,
    "encode_labels": q_encode_labels,
    "decode_labels": q_decode_labels,
    "sorted_encoder": q_sorted_encoder,
    "region_chunks": q_region_chunks,
    "region_view": q_region_view,
    "token_windows": q_token_windows,
    "region_training_set": q_region_training_set,
    "union_regions": q_union_regions,
    "prompt_rows": q_prompt_rows,
    "term_features": q_term_features,
    "fit_region_models": q_fit_region_models,
    "best_epoch": q_best_epoch,
    "average_models": q_average_models,
    "weighted_average": q_weighted_average,
    "fuse_into": q_fuse_into,
    "check_compatible": q_check_compatible,
    "finetune_step": q_finetune_step,
    "chunk_scores": q_chunk_scores,
    "chunk_softmax": q_chunk_softmax,
    "doc_mean_probs": q_doc_mean_probs,
    "doc_argmax": q_doc_argmax,
    "doc_predictions": q_doc_predictions,
    "attach_gold": q_attach_gold,
    "parse_generated": q_parse_generated,
    "doc_max_vote": q_doc_max_vote,
    "binary_threshold": q_binary_threshold,
    "metrics": q_metrics,
    "per_label_report": q_per_label_report,
    "fold_summary": q_fold_summary,
    "fused_documents": q_fused_documents,
    "fuse_only_metrics": q_fuse_only_metrics,
    "vote_metrics": q_vote_metrics,
    "baseline_docs": q_baseline_docs,
    "untrained_docs": q_untrained_docs,
    "baseline_metrics": q_baseline_metrics,
    "untrained_metrics": q_untrained_metrics,
    "paragraph_chunks": q_paragraph_chunks,
    "fuse_stored": q_fuse_stored,
    "fit_batches": q_fit_batches,
    "best_step": q_best_step,
    "fit_local": q_fit_local,
    "best_round": q_best_round,
    "attach_gold_first": q_attach_gold_first,
    "average_blocks": q_average_blocks,
    "prediction_prompts": q_prediction_prompts,
    **corpora.QUERIES,
}
