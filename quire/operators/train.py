"""Softmax regression over term features, trained as relational steps.

State is a parameter table ``(model_id, part, param, param_id, w_0..w_{k-1})``;
the head row counts as one more feature of value 1.  One full-batch gradient
step: features joined with the weights -> per-chunk logits (aggregation on the
chunk key) -> softmax -> residual ``p - y``, joined back to the chunk's row ->
``sum(tf * residual)`` per (model, term), which combines in each task first.
The residual is computed once, in the same job, and feeds body and head alike.

The feature store has one row per chunk and is bucketed on the chunk key, so
the logit aggregation and the residual join need no shuffle as long as the
weights are small enough to broadcast.  Beyond that a second copy of the features,
one row per chunk and term, is bucketed by (model, term) once, and every epoch's weights
are stored in the same buckets: the weights join is local and only the chunks'
partial logits move.  Terms that very many chunks hold are spread over salts, with
their weights repeated.  Several models (one per region) train in the same
jobs: ``model_id`` is just a column.  Each epoch's parameters are written to
the checkpoint folder, which cuts the lineage.

``fit`` takes full-batch steps.  ``fit_batches`` takes mini-batch steps (batches by a hash
of the chunk, stored as partitions), with the optimiser's moments as parameter columns, and
evaluates at step numbers.  ``fit_local`` takes its mini-batch steps inside shards of the chunks, all
shards at once in one job, and averages the shards' parameters by key after every round.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.arrays import names, softmax
from quire.functions.joins import broadcast_if_small
from quire.operators.features import CHUNK_KEY, shard_of
from quire.session import cut_lineage, store_bucketed

MODEL = "model_id"
HEAD_ID = -1  # param_id of the head row


def init_params(vocab: DataFrame, model_ids: list[int], k: int) -> DataFrame:
    """All-zero parameters: one body row per (model, vocabulary term), one head
    row per model.  ``vocab`` has ``term`` and its integer ``term_id``; body
    rows keep both (``param``, ``param_id``) and joins use the integer."""
    zeros = [F.lit(0.0).alias(w) for w in names("w", k)]
    ids = F.array(*[F.lit(int(m)) for m in model_ids])
    body = vocab.select(F.explode(ids).alias(MODEL), F.lit("body").alias("part"), F.col("term").alias("param"),
                        F.col("term_id").cast("long").alias("param_id"), *zeros)
    head = (vocab.sparkSession.range(1)
            .select(F.explode(ids).alias(MODEL), F.lit("head").alias("part"), F.lit("bias").alias("param"),
                    F.lit(HEAD_ID).cast("long").alias("param_id"), *zeros))
    return body.unionByName(head)


def _with_head(feats: Column) -> Column:
    """The chunk's features and the head's constant one."""
    one = F.array(F.struct(F.lit(HEAD_ID).cast("long").alias("term_id"), F.lit(1.0).alias("tf")))
    return F.concat(one, F.coalesce(feats, F.array().cast("array<struct<term_id:bigint,tf:double>>")))


def chunk_logits(chunks: DataFrame, params: DataFrame, k: int, body_rows: int | None = None,
                 keep: list[str] | None = None) -> DataFrame:
    """``CHUNK_KEY + [model_id] + keep + [l_0..l_{k-1}]``: raw class scores.

    ``chunks`` has one row per chunk (``CHUNK_KEY``, ``model_id``, ``feats`` and
    ``keep``); a chunk without any known term scores the intercept only."""
    keep = list(keep or [])
    w = params.select(MODEL, F.col("param_id").alias("term_id"), *names("w", k))
    w = broadcast_if_small(w, body_rows, 24 + 8 * k)
    rows = chunks.select(*CHUNK_KEY, MODEL, *keep, F.inline(_with_head(F.col("feats"))))
    return (rows.join(w, [MODEL, "term_id"]).groupBy(*CHUNK_KEY, MODEL, *keep)
            .agg(*[F.sum(F.col("tf") * F.col(c)).alias(l) for c, l in zip(names("w", k), names("l", k))]))


TERM_ROWS = 1_000_000  # rows of one (model, term) that share a salt


@dataclass
class TermStore:
    """The features of some chunks by term: ``rows`` (CHUNK_KEY, model_id, term_id, salt, tf) in ``n`` buckets of
    (model, term, salt); ``hot`` (model_id, term_id, salts) names the terms with more than one salt."""

    rows: DataFrame
    hot: DataFrame
    n: int


TERM_KEY = [MODEL, "term_id", "salt"]


def term_store(chunks: DataFrame, n: int, term_rows: int | None = None) -> TermStore:
    """The TermStore of ``chunks`` (CHUNK_KEY, model_id, feats); the one shuffle of the features by term."""
    term_rows = term_rows or TERM_ROWS
    rows = chunks.select(*CHUNK_KEY, MODEL, F.inline("feats"))
    many = rows.groupBy(MODEL, "term_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > term_rows)
    hot = cut_lineage(many.select(MODEL, "term_id", F.ceil(F.col("n") / term_rows).cast("int").alias("salts")))
    salt = F.pmod(F.xxhash64(*CHUNK_KEY), F.coalesce("salts", F.lit(1))).cast("int")
    salted = rows.join(broadcast_if_small(hot), [MODEL, "term_id"], "left").select(*CHUNK_KEY, MODEL, "term_id", salt.alias("salt"), "tf")
    return TermStore(store_bucketed(salted, n, TERM_KEY), hot, n)


def term_weights(params: DataFrame, store: TermStore, k: int) -> DataFrame:
    """The body weights in the store's buckets, a hot term's once per salt."""
    body = params.where(F.col("part") == "body").select(MODEL, F.col("param_id").alias("term_id"), *names("w", k))
    salts = F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt")
    told = body.join(broadcast_if_small(store.hot), [MODEL, "term_id"], "left").select(MODEL, "term_id", salts, *names("w", k))
    return store_bucketed(told, store.n, TERM_KEY)


def logits_by_term(chunks: DataFrame, params: DataFrame, weights: DataFrame, store: TermStore, k: int,
                   keep: list[str] | None = None) -> DataFrame:
    """``chunk_logits`` for weights beyond the broadcast limits: the weights meet the terms bucket by bucket,
    partial logits move to their chunk's bucket, and the head (one row per model) is added there."""
    keep = list(keep or [])
    partial = store.rows.join(weights, TERM_KEY).groupBy(*CHUNK_KEY).agg(
        *[F.sum(F.col("tf") * F.col(w)).alias(f"s_{c}") for c, w in enumerate(names("w", k))])
    head = params.where(F.col("part") == "head").select(MODEL, *[F.col(w).alias(f"h_{c}") for c, w in enumerate(names("w", k))])
    rows = chunks.select(*CHUNK_KEY, MODEL, *keep).join(partial, CHUNK_KEY, "left").join(F.broadcast(head), MODEL, "left")
    zero = F.lit(0.0)
    return rows.select(*CHUNK_KEY, MODEL, *keep, *[
        (F.coalesce(f"s_{c}", zero) + F.coalesce(f"h_{c}", zero)).alias(l) for c, l in enumerate(names("l", k))])


@dataclass
class ShardStore:
    """Chunks by shard: ``rows`` (shard, CHUNK_KEY, model_id, label_idx, ids, tfs and more) lie in buckets of the shard;
    ``wanted`` (shard, model_id, param_id) names the parameters that each shard's chunks hold, in ``n`` buckets of (model,
    parameter).  The features of a shard never move: its weights come to it and its gradient leaves it, a row per
    distinct term, which many chunks of the shard share."""

    rows: DataFrame
    wanted: DataFrame
    n: int


PARAM_KEY = [MODEL, "param_id"]


def by_key(params: DataFrame, n: int) -> DataFrame:
    """Parameters stored where a ShardStore's ``wanted`` and gradients meet them without a shuffle."""
    return store_bucketed(params, n, PARAM_KEY)


def rows_by_shard(chunks: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """Chunks without a document id have no features, as no join on the chunk key meets them."""
    feats = F.when(F.col("doc_id").isNotNull(), F.col("feats"))
    none = lambda t: F.array().cast(f"array<{t}>")
    return chunks.select("shard", *CHUNK_KEY, MODEL, F.col("label_idx").cast("int").alias("label_idx"), *more,
                         F.coalesce(feats["term_id"], none("bigint")).alias("ids"), F.coalesce(feats["tf"], none("double")).alias("tfs"))


def shard_params(rows: DataFrame, n: int, parts: tuple[str, ...] = ()) -> DataFrame:
    """The ``wanted`` of a ShardStore with these rows, the head's row included; with ``parts`` a folder per value."""
    ids = F.explode(F.concat(F.array(F.lit(HEAD_ID).cast("long")), "ids")).alias("param_id")
    return store_bucketed(rows.select("shard", *parts, MODEL, ids).distinct(), n, PARAM_KEY, parts)


def shard_store(chunks: DataFrame, n: int) -> ShardStore:
    """The ShardStore of ``chunks`` (shard, CHUNK_KEY, model_id, label_idx, feats), read where they lie if they are bucketed
    by shard; chunks that have no shard are dealt by document and stored once."""
    if "shard" not in chunks.columns:
        chunks = store_bucketed(chunks.withColumn("shard", shard_of(F.col("doc_id"), n, chunks.sparkSession)), n, ["shard"])
    rows = rows_by_shard(chunks)
    return ShardStore(rows, shard_params(rows, n), n)


def shard_entries(samples: pa.Table, weights: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``row, tf, place`` of the features that have a weight (``place``: its row in ``weights``), and each sample's head."""
    lengths = pc.list_value_length(samples["ids"]).to_numpy()
    ids, tf = pc.list_flatten(samples["ids"]).to_numpy(), pc.list_flatten(samples["tfs"]).to_numpy()
    row = np.repeat(np.arange(len(lengths)), lengths)
    model, owner, param = samples[MODEL].to_numpy(), weights[MODEL].to_numpy(), weights["param_id"].to_numpy()
    place, head = np.full(len(ids), -1), np.full(len(lengths), -1)
    for m in np.unique(owner):
        mine = np.flatnonzero(owner == m)
        mine = mine[np.argsort(param[mine])]

        def find(wanted):
            at = mine[np.minimum(np.searchsorted(param[mine], wanted), len(mine) - 1)]
            return np.where(param[at] == wanted, at, -1)

        of = np.flatnonzero(model[row] == m)
        place[of] = find(ids[of])
        head[model == m] = find(np.array([HEAD_ID]))[0]
    known = place >= 0
    return row[known], tf[known], place[known], head


def chunk_numbers(samples: pa.Table, *more: str) -> np.ndarray:
    """A number per sample, equal where the chunk key (and ``more``) is: rows of a repeated chunk count as one."""
    return samples.select([*CHUNK_KEY, *more]).to_pandas().groupby([*CHUNK_KEY, *more], dropna=False, sort=False).ngroup().to_numpy(dtype=np.int64)


def class_sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """``n`` x classes: the rows of ``values`` summed by ``at``."""
    return np.stack([np.bincount(at, values[:, c], minlength=n) for c in range(values.shape[1])], axis=1)


class ShardScores:
    """A shard's logits under its weights, one row per chunk (and ``more``): ``first`` is a sample of each."""

    def __init__(self, samples: pa.Table, weights: pa.Table, k: int, *more: str):
        self.samples, self.weights = samples, weights
        self.row, self.tf, self.place, head = shard_entries(samples, weights)
        w = np.stack([weights[c].to_numpy() for c in names("w", k)], axis=1) if len(weights) else np.zeros((1, k))
        self.chunk = chunk_numbers(samples)
        self.group = chunk_numbers(samples, *more) if more else self.chunk
        self.n = int(self.chunk.max(initial=-1)) + 1
        body = np.stack([np.bincount(self.chunk[self.row], self.tf * w[self.place, c], minlength=self.n) for c in range(k)], axis=1)
        copies = np.bincount(self.group)
        _, self.first = np.unique(self.group, return_index=True)
        bias = np.where(head[self.first, None] >= 0, w[head[self.first]], 0.0)
        self.head, self.logits = head, copies[:, None] * (body[self.chunk[self.first]] + bias)

    def of(self, column: str) -> np.ndarray:
        return self.samples[column].to_numpy()[self.first]

    def probs(self) -> np.ndarray:
        e = np.exp(self.logits - self.logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def shard_gradient(samples: pa.Table, weights: pa.Table, k: int) -> pa.Table:
    """``(model_id, param_id, g_c)``: the shard's summed gradient for each of its weights."""
    s = ShardScores(samples, weights, k, "label_idx")
    resid = s.probs() - (s.of("label_idx")[:, None] == np.arange(k))
    there = ~pc.is_null(samples["doc_id"]).to_numpy(zero_copy_only=False)
    copies = np.bincount(s.chunk[there], minlength=s.n)
    moved = copies[:, None] * class_sums(s.chunk[s.first], resid, s.n)
    total = np.stack([np.bincount(s.place, s.tf * moved[s.chunk[s.row], c], minlength=len(weights)) for c in range(k)], axis=1)
    _, one = np.unique(s.chunk, return_index=True)
    headed = s.head[one] >= 0
    total += class_sums(s.head[one][headed], moved[headed], len(weights))
    return pa.table([weights[MODEL], weights["param_id"], *total.T], names=[MODEL, "param_id", *names("g", k)])


def shard_losses(samples: pa.Table, weights: pa.Table, k: int) -> pa.Table:
    """``(model_id, n, nll)`` of the shard's labelled chunks."""
    s = ShardScores(samples, weights, k, "label_idx")
    true = s.probs()[np.arange(len(s.first)), s.of("label_idx")]
    told = pd.DataFrame({MODEL: s.of(MODEL), "nll": -np.log(np.maximum(true, 1e-300))}).groupby(MODEL)["nll"].agg(["size", "sum"])
    return pa.table([told.index.to_numpy(dtype=np.int32), told["size"].to_numpy(dtype=np.int64), told["sum"].to_numpy(dtype=float)], names=[MODEL, "n", "nll"])


def shard_chunk_scores(samples: pa.Table, weights: pa.Table, k: int) -> pa.Table:
    s = ShardScores(samples, weights, k)
    keys = samples.select([*CHUNK_KEY, MODEL]).take(pa.array(s.first))
    return pa.table([*keys.columns, *s.logits.T], names=[*CHUNK_KEY, MODEL, *names("l", k)])


def at_shards(store: ShardStore, params: DataFrame, k: int, work, schema: str) -> DataFrame:
    """``work(samples, weights, k)`` of every shard, its weights brought to it."""
    weights = store.wanted.join(params.select(*PARAM_KEY, *names("w", k)), PARAM_KEY).select("shard", *PARAM_KEY, *names("w", k))
    return store.rows.groupBy("shard").cogroup(weights.groupBy("shard")).applyInArrow(lambda samples, mine: work(samples, mine, k), schema)


def _doubles(prefix: str, k: int) -> str:
    return ", ".join(f"{c} double" for c in names(prefix, k))


def shard_logits(params: DataFrame, store: ShardStore, k: int) -> DataFrame:
    """``chunk_logits`` with the weights brought to the shards."""
    keys = ", ".join(f"{c} {t}" for c, t in store.rows.select(*CHUNK_KEY, MODEL).dtypes)
    return at_shards(store, params, k, shard_chunk_scores, f"{keys}, {_doubles('l', k)}")


def with_probs(logits: DataFrame, k: int) -> DataFrame:
    """Add ``p_0..p_{k-1}`` (row-wise softmax of the logits) and drop the logits."""
    probs = softmax([F.col(l) for l in names("l", k)])
    others = [c for c in logits.columns if c not in names("l", k)]
    return logits.select(*others, *[p.alias(n) for p, n in zip(probs, names("p", k))])


def logits(chunks: DataFrame, params: DataFrame, k: int, body_rows: int | None, store: TermStore | None) -> DataFrame:
    """The labelled chunks' logits, by broadcast weights or through the term store."""
    if store is None:
        return chunk_logits(chunks, params, k, body_rows, ["label_idx"])
    return logits_by_term(chunks, params, term_weights(params, store, k), store, k, ["label_idx"])


def gradient(params: DataFrame, chunks: DataFrame, k: int, body_rows: int | None = None,
             store: TermStore | ShardStore | None = None) -> DataFrame:
    """``(model_id, param_id, g_0..g_{k-1})``: summed gradient of the cross-entropy.

    ``chunks``: ``CHUNK_KEY, model_id, label_idx`` (non-null), ``feats``.  One job:
    the store is scanned for the logits and met again, bucket by bucket, by the
    residuals (one row per chunk on either side).  With a TermStore the logits come by term, with a
    ShardStore (of the chunks) the shards' gradients are summed."""
    if isinstance(store, ShardStore):
        moved = at_shards(store, params, k, shard_gradient, f"{MODEL} int, param_id long, {_doubles('g', k)}")
        # a shard has one row per key and a task few shards: rows go to their key's bucket as they are
        return moved.repartition(store.n, *PARAM_KEY).groupBy(*PARAM_KEY).agg(*[F.sum(g).alias(g) for g in names("g", k)])
    probs = with_probs(logits(chunks, params, k, body_rows, store), k)
    resid = probs.select(*CHUNK_KEY, *[(F.col(p) - F.when(F.col("label_idx") == c, 1.0).otherwise(0.0)).alias(e)
                                       for c, (p, e) in enumerate(zip(names("p", k), names("e", k)))])
    rows = chunks.select(*CHUNK_KEY, MODEL, "feats").join(resid, CHUNK_KEY).select(
        MODEL, *names("e", k), F.inline(_with_head(F.col("feats"))))
    return rows.groupBy(MODEL, F.col("term_id").alias("param_id")).agg(
        *[F.sum(F.col("tf") * F.col(e)).alias(g) for e, g in zip(names("e", k), names("g", k))])


def gradient_step(params: DataFrame, chunks: DataFrame, k: int, lr: float, body_rows: int | None = None,
                  counts: DataFrame | None = None, store: TermStore | ShardStore | None = None) -> DataFrame:
    """One full-batch gradient step of mean cross-entropy for every model at once.
    ``counts`` (model_id, n: labelled chunks) is derived when not given."""
    n = F.broadcast(sample_counts(chunks) if counts is None else counts)  # one row per model
    step = lambda w, g: F.col(w) - F.lit(lr) * F.coalesce(F.col(g) / F.col("n"), F.lit(0.0))
    return (params.join(gradient(params, chunks, k, body_rows, store), [MODEL, "param_id"], "left").join(n, MODEL, "left")
            .select(MODEL, "part", "param", "param_id", *[step(w, g).alias(w) for w, g in zip(names("w", k), names("g", k))]))


def sample_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy(MODEL).agg(F.count(F.lit(1)).alias("n"))


def mean_loss(params: DataFrame, chunks: DataFrame, k: int, body_rows: int | None = None,
              store: TermStore | ShardStore | None = None) -> DataFrame:
    """``(model_id, n, loss)``: mean cross-entropy of the labelled chunks."""
    if isinstance(store, ShardStore):
        told = at_shards(store, params, k, shard_losses, f"{MODEL} int, n long, nll double")
        return told.groupBy(MODEL).agg(F.sum("n").alias("n"), (F.sum("nll") / F.sum("n")).alias("loss"))
    probs = with_probs(logits(chunks, params, k, body_rows, store), k)
    p_true = F.get(F.array(*[F.col(p) for p in names("p", k)]), F.col("label_idx"))
    nll = -F.log(F.greatest(p_true, F.lit(1e-300)))
    return probs.groupBy(MODEL).agg(F.count(F.lit(1)).alias("n"), F.avg(nll).alias("loss"))


@dataclass
class FitResult:
    params: DataFrame
    history: DataFrame  # (model_id, epoch, dev_loss, best)
    best_epoch: dict = field(default_factory=dict)


def fit(params: DataFrame, chunks: DataFrame, k: int, lr: float, epochs: int, dev_chunks: DataFrame | None = None,
        body_rows: int | None = None, n_parts: int | None = None) -> FitResult:
    """``epochs`` gradient steps; with a dev set each model keeps the epoch of
    lowest dev loss (the best-model rule of evaluation during training).  A
    model without labelled dev chunks keeps its last epoch.  Rows without a
    label index are left out.  With ``n_parts`` (the chunk store's buckets) the chunks stay in their
    shards, whatever the number of weights."""
    spark = params.sparkSession
    chunks = chunks.filter(F.col("label_idx").isNotNull())
    store = shard_store(chunks, n_parts) if n_parts else None
    if dev_chunks is not None:
        dev_chunks = dev_chunks.filter(F.col("label_idx").isNotNull())
    dev_store = shard_store(dev_chunks, n_parts) if n_parts and dev_chunks is not None else None
    keep = (lambda p: by_key(p, n_parts)) if n_parts else cut_lineage
    current = keep(params)
    counts = cut_lineage(sample_counts(chunks))
    models = sorted(r[0] for r in current.select(MODEL).distinct().collect())  # one row per model
    per_epoch: list[DataFrame] = []
    losses: dict[int, dict[int, float]] = {m: {} for m in models}
    for epoch in range(1, epochs + 1):
        current = keep(gradient_step(current, chunks, k, lr, body_rows, counts, store))
        per_epoch.append(current)
        if dev_chunks is not None:
            for r in mean_loss(current, dev_chunks, k, body_rows, dev_store).collect():
                losses[r[MODEL]][epoch] = float(r["loss"])
    # lowest dev loss per model; the earlier epoch wins a tie
    best = {m: min(told, key=lambda e: (told[e], e)) if told else epochs for m, told in losses.items()}
    result = current.limit(0) if per_epoch else current
    for e, p in enumerate(per_epoch, start=1):
        kept = [m for m, b in best.items() if b == e]
        if kept:
            part = p.filter(F.col(MODEL).isin(kept))
            result = part if len(kept) == len(models) else result.unionByName(part)
    history = spark.createDataFrame(
        [(m, e, losses[m].get(e), best[m] == e) for m in models for e in range(1, epochs + 1)],
        "model_id int, epoch int, dev_loss double, best boolean")
    return FitResult(result, history, best)


# Adam's usual decay rates and denominator term.
ADAM_BETA1, ADAM_BETA2, ADAM_EPS = 0.9, 0.999, 1e-8


def with_moments(params: DataFrame, k: int) -> DataFrame:
    """Parameters with the optimiser's moments ``m_c`` and ``v_c`` (zero) as columns."""
    return params.select("*", *[F.lit(0.0).alias(c) for c in names("m", k) + names("v", k)])


def adam_step(params: DataFrame, chunks: DataFrame, k: int, lr: float, step: int, body_rows: int | None = None,
              store: ShardStore | None = None) -> DataFrame:
    """One Adam step on the mean gradient of ``chunks`` (a batch).  A model without a chunk in the batch, and
    a term that the batch lacks, have gradient zero: their moments decay."""
    n = F.broadcast(sample_counts(chunks))  # one row per model
    rows = params.join(gradient(params.drop(*names("m", k), *names("v", k)), chunks, k, body_rows, store), [MODEL, "param_id"], "left").join(n, MODEL, "left")
    out = []
    for c in range(k):
        g = F.coalesce(F.col(f"g_{c}") / F.col("n"), F.lit(0.0))
        m = ADAM_BETA1 * F.col(f"m_{c}") + (1 - ADAM_BETA1) * g
        v = ADAM_BETA2 * F.col(f"v_{c}") + (1 - ADAM_BETA2) * g * g
        move = F.lit(lr) * (m / (1 - ADAM_BETA1 ** step)) / (F.sqrt(v / (1 - ADAM_BETA2 ** step)) + ADAM_EPS)
        out.append((F.col(f"w_{c}") - move, m, v))
    w, m, v = zip(*out)
    return rows.select(MODEL, "part", "param", "param_id", *[x.alias(a) for x, a in zip((*w, *m, *v), names("w", k) + names("m", k) + names("v", k))])


def batch_of(batches: int, seed: int = 777) -> Column:
    """The batch of a chunk: a hash of its key, so it is the same whatever the order of the rows."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in CHUNK_KEY]))
    return (F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % batches).cast("int")


@dataclass
class BatchFit:
    params: DataFrame
    history: DataFrame  # (model_id, step, dev_loss, best): evaluated steps only


def fit_batches(params: DataFrame, chunks: DataFrame, k: int, lr: float, epochs: int, batches: int, dev_chunks: DataFrame,
                eval_every: int, n_parts: int, body_rows: int | None = None, seed: int = 777) -> BatchFit:
    """``epochs`` passes of ``batches`` Adam steps; each model keeps the evaluated step of lowest dev loss.

    The samples are stored once, in their shards and with a folder per batch, so a step reads
    its own batch alone and gets the weights of that batch's terms.  Steps are numbered from 1; the dev loss is taken
    every ``eval_every`` steps and after the last one, and the earlier of equal steps wins.  The parameters of evaluated
    steps are stored candidates; a model without dev chunks keeps the last step."""
    spark = params.sparkSession
    known = chunks.filter(F.col("label_idx").isNotNull()).withColumn("batch", batch_of(batches, seed))
    if "shard" not in known.columns:
        known = known.withColumn("shard", shard_of(F.col("doc_id"), n_parts, spark))
    stored = store_bucketed(rows_by_shard(known, ("batch",)), n_parts, ["shard"], ("batch",))
    wanted = shard_params(stored, n_parts, ("batch",))
    dev = dev_chunks.filter(F.col("label_idx").isNotNull())
    dev_store = shard_store(dev, n_parts)
    current = by_key(with_moments(params, k), n_parts)
    last = epochs * batches
    candidates, history = {}, []
    for step in range(1, last + 1):
        batch, held = (x.where(F.col("batch") == (step - 1) % batches).drop("batch") for x in (stored, wanted))
        current = by_key(adam_step(current, batch, k, lr, step, body_rows, ShardStore(batch, held, n_parts)), n_parts)
        if step % eval_every == 0 or step == last:
            candidates[step] = current
            history += [(r[MODEL], step, r["loss"]) for r in mean_loss(current, dev, k, body_rows, dev_store).collect()]  # a row per model
    return _best(candidates, spark.createDataFrame(history, f"{MODEL} int, step int, dev_loss double"), current, last, k)


def _best(candidates: dict[int, DataFrame], told: DataFrame, current: DataFrame, last: int, k: int) -> BatchFit:
    """Each model's parameters at its evaluated step of lowest dev loss (``told``), and the marked history."""
    best = told.groupBy(MODEL).agg(F.min_by("step", F.struct("dev_loss", "step")).alias("best_step"))
    models = current.select(MODEL).distinct().join(F.broadcast(best), MODEL, "left").select(MODEL, F.coalesce("best_step", F.lit(last)).alias("best_step"))
    models = cut_lineage(models)  # one row per model
    out = None
    for step, p in candidates.items():
        part = p.join(F.broadcast(models.where(F.col("best_step") == step).select(MODEL)), MODEL, "left_semi")
        part = part.select(MODEL, "part", "param", "param_id", *names("w", k))
        out = part if out is None else out.unionByName(part)
    marked = told.join(F.broadcast(models), MODEL).select(MODEL, "step", "dev_loss", (F.col("step") == F.col("best_step")).alias("best"))
    return BatchFit(current.select(MODEL, "part", "param", "param_id", *names("w", k)) if out is None else out, marked)


SHARD_ROWS = 2_000  # chunks of a shard, about: what one task holds


def local_steps(samples: pa.Table, weights: pa.Table, k: int, lr: float, batches: int) -> pa.Table:
    """``(model_id, param_id, d_0..d_{k-1})``: what one pass of ``batches`` gradient steps over each of the shards in
    ``samples`` (CHUNK_KEY, model_id, label_idx, part, batch, ids, tfs; ``part`` is the shard) moves the common ``weights``
    (model_id, param_id, w_c), summed over these shards."""
    start = np.stack([weights[c].to_numpy() for c in names("w", k)], axis=1)
    row, tf, place, head = shard_entries(samples, weights)
    chunk, owner = chunk_numbers(samples), weights[MODEL].to_numpy()
    label, batch, part, model = (samples[c].to_numpy() for c in ("label_idx", "batch", "part", MODEL))
    moved = np.zeros_like(start)
    by_part = np.argsort(part[row], kind="stable")
    row, tf, place = row[by_part], tf[by_part], place[by_part]
    for p in np.unique(part):
        mine = np.flatnonzero(part == p)
        a, b = np.searchsorted(part[row], [p, p + 1])
        _, at = np.unique(chunk[mine], return_inverse=True)  # the shard's chunks, numbered
        number = np.full(len(part), -1)
        number[mine] = at
        used, local = np.unique(np.concatenate([place[a:b], head[mine]]), return_inverse=True)  # the shard's weights, numbered
        body, bias = local[:b - a], local[b - a:]
        first = start[used]
        w, of, t = first.copy(), number[row[a:b]], tf[a:b]
        for i in range(batches):
            now = batch[mine] == i  # all rows of a chunk are in one batch
            if not now.any():
                continue
            on = batch[row[a:b]] == i
            sums = np.stack([np.bincount(of[on], t[on] * w[body[on], c], minlength=len(mine)) for c in range(k)], axis=1)
            logit = sums[at[now]] + w[bias[now]]
            e = np.exp(logit - logit.max(axis=1, keepdims=True))
            resid = e / e.sum(axis=1, keepdims=True) - (label[mine][now][:, None] == np.arange(k))
            told = class_sums(at[now], resid, len(mine))
            grad = np.stack([np.bincount(body[on], t[on] * told[of[on], c], minlength=len(w)) for c in range(k)], axis=1)
            grad += class_sums(bias[now], resid, len(w))
            n = pd.Series(model[mine][now]).value_counts().reindex(owner[used]).to_numpy()  # of the model's chunks in the batch, or nan
            w -= lr * np.nan_to_num(grad / n[:, None])
        moved[used] += w - first
    return pa.table([weights[MODEL], weights["param_id"], *moved.T], names=[MODEL, "param_id", *names("d", k)])


def fit_local(params: DataFrame, chunks: DataFrame, k: int, lr: float, rounds: int, batches: int, dev_chunks: DataFrame,
              n_parts: int, body_rows: int | None = None, shard_rows: int = SHARD_ROWS, seed: int = 777) -> BatchFit:
    """``rounds`` passes over the chunks, each one job: every shard starts from the common parameters, takes
    ``batches`` gradient steps on its own chunks, and the shards' parameters are averaged by key.

    Shards are a hash of the chunk, so their sizes vary little around ``shard_rows`` whatever the keys, and their
    number grows with the chunks.  The shards are dealt to ``n_parts`` stores: a store gets the weights of its own terms
    only and gives back what its shards moved; a shard without a term, or without a chunk of a model, holds it unmoved,
    so the sum of the moves over the number of shards is the average.  Rows without a label index are left out.  The dev
    loss is taken after every round (``step`` of the history); each model keeps its best round, the earlier of equal
    ones, and without dev chunks the last."""
    spark = params.sparkSession
    known = chunks.filter(F.col("label_idx").isNotNull())
    shards = max(1, math.ceil(known.count() / shard_rows))
    dealt = known.withColumn("part", batch_of(shards, seed + 1)).withColumn("batch", batch_of(batches, seed))
    dealt = dealt.withColumn("shard", shard_of(F.col("part"), n_parts, spark))
    stored = store_bucketed(rows_by_shard(dealt, ("part", "batch")), n_parts, ["shard"])
    store = ShardStore(stored, shard_params(stored, n_parts), n_parts)
    dev = dev_chunks.filter(F.col("label_idx").isNotNull())
    dev_store = shard_store(dev, n_parts)
    current = by_key(params, n_parts)
    candidates, history = {}, []
    for step in range(1, rounds + 1):
        moves = at_shards(store, current, k, lambda samples, mine, k: local_steps(samples, mine, k, lr, batches),
                          f"{MODEL} int, param_id long, {_doubles('d', k)}")
        total = moves.repartition(n_parts, *PARAM_KEY).groupBy(*PARAM_KEY).agg(*[F.sum(d).alias(d) for d in names("d", k)])
        current = by_key(current.join(total, PARAM_KEY, "left").select(
            MODEL, "part", "param", "param_id",
            *[(F.col(w) + F.coalesce(F.col(d), F.lit(0.0)) / shards).alias(w) for w, d in zip(names("w", k), names("d", k))]), n_parts)
        candidates[step] = current
        history += [(r[MODEL], step, r["loss"]) for r in mean_loss(current, dev, k, body_rows, dev_store).collect()]  # a row per model
    return _best(candidates, spark.createDataFrame(history, f"{MODEL} int, step int, dev_loss double"), current, rounds, k)
