import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions.arrays import argmax_first
from quire.functions.joins import fits_broadcast, measure
from quire.operators.features import chunk_terms, feature_store, number_terms, term_rows, term_vocabulary
from quire.operators.params import (FUSED_ID, assert_compatible, average_blocks, average_models, check_compatible, from_blocks,
                                    fuse_into, fuse_models, read_params, to_blocks, write_params)
from quire.operators.train import (adam_step, batch_of, fit, fit_batches, fit_local, gradient_step, init_params, logits_by_term, term_store,
                                   term_weights, with_moments)


def vec_params(spark, rows):
    return spark.createDataFrame(rows, "model_id int, pos int, value double")


def test_weighted_average_first_weight_ignored(spark):
    p = vec_params(spark, [(0, 0, 1.0), (1, 0, 3.0)])
    got = average_models(p, ["pos"], ["value"], weights=[5, 2]).first()["value"]
    assert got == pytest.approx(1 / 2 + 2 * 3 / 2)  # 3.5
    got = average_models(p, ["pos"], ["value"], weights=[5, 2], apply_first_weight=True).first()["value"]
    assert got == pytest.approx(5 / 2 + 2 * 3 / 2)


def test_weight_count_must_match(spark):
    p = vec_params(spark, [(0, 0, 1.0), (1, 0, 3.0)])
    with pytest.raises(ValueError, match="weights for"):
        average_models(p, ["pos"], ["value"], weights=[1, 2, 3]).collect()


def test_fuse_same_model_is_identity(spark):
    rows = [(0, i, float(i) * 0.5 - 1) for i in range(10)]
    same = vec_params(spark, rows + [(1, i, v) for _, i, v in rows])
    got = {r.pos: r.value for r in average_models(same, ["pos"], ["value"]).collect()}
    assert got == pytest.approx({i: v for _, i, v in rows})


def test_check_compatible(spark):
    p = vec_params(spark, [(0, 0, 1.0), (0, 1, 1.0), (1, 0, 2.0)])
    bad = check_compatible(p, ["pos"]).collect()
    assert [(r.pos, r.n_models, r.n_with_key) for r in bad] == [(1, 2, 1)]
    with pytest.raises(ValueError, match="missing in some models"):
        assert_compatible(p, ["pos"])


def test_fuse_into_keeps_head(spark):
    base = spark.createDataFrame([(9, "body", "a", 0.0), (9, "head", "bias", 7.0)],
                                 "model_id int, part string, param string, w_0 double")
    avg = spark.createDataFrame([("body", "a", 2.0), ("head", "bias", 1.0)], "part string, param string, w_0 double")
    got = {(r.part, r.param): r.w_0 for r in fuse_into(base, avg, ["part", "param"], ["w_0"]).collect()}
    assert got == {("body", "a"): 2.0, ("head", "bias"): 7.0}


def _toy(spark):
    chunks = spark.createDataFrame(
        [(1, 0, 0, "red red blue", 0), (2, 0, 0, "blue green", 1), (3, 0, 0, "red", 0), (4, 0, 0, "zzz", 1)],
        "doc_id long, region int, sub int, chunk string, label_idx int")
    chunked = chunk_terms(chunks, carry=["label_idx"])
    counts = term_rows(chunked)
    vocab = number_terms(term_vocabulary(counts))
    store = feature_store(chunked, vocab, 4, ["label_idx"]).withColumn("model_id", F.lit(0))
    return counts, vocab, store


def test_gradient_step_matches_numpy(spark):
    counts, vocab, store = _toy(spark)
    k, lr = 2, 0.5
    p1 = gradient_step(init_params(vocab, [0], k), store, k, lr)
    got = {(r.part, r.param): (r.w_0, r.w_1) for r in p1.collect()}
    # brute force: zero weights -> p = 1/2, residual = 1/2 - y
    terms = sorted(r.term for r in vocab.collect())
    X = np.zeros((4, len(terms)))
    for r in counts.collect():
        X[r.doc_id - 1, terms.index(r.term)] = r.tf
    y = np.array([0, 1, 0, 1])
    E = np.full((4, 2), 0.5) - np.eye(2)[y]
    W = -lr * X.T @ E / 4
    b = -lr * E.sum(0) / 4
    for i, t in enumerate(terms):
        assert got[("body", t)] == pytest.approx(tuple(W[i]))
    assert got[("head", "bias")] == pytest.approx(tuple(b))
    # tf rows have unit L2 norm per chunk
    assert np.allclose(np.linalg.norm(X[:3], axis=1), 1.0)


def test_fit_reduces_loss_and_keeps_best(spark):
    _, vocab, store = _toy(spark)
    res = fit(init_params(vocab, [0], 2), store, 2, 2.0, 3, store)
    h = sorted((r.epoch, r.dev_loss, r.best) for r in res.history.collect())
    assert h[0][1] < math.log(2)
    assert sum(1 for _, _, b in h if b) == 1
    assert res.params.count() == vocab.count() + 1


def test_fuse_models_and_params_roundtrip(spark, tmpdir_path):
    _, vocab, _ = _toy(spark)
    models = init_params(vocab, [0, 1], 2).withColumn("w_0", F.when(F.col("model_id") == 1, 2.0).otherwise(0.0))
    fused = fuse_models(init_params(vocab, [FUSED_ID], 2), models, 2)
    vals = {(r.part, r.w_0) for r in fused.collect()}
    assert vals == {("body", 1.0), ("head", 0.0)}
    write_params(fused, tmpdir_path + "/p")
    back = read_params(spark, tmpdir_path + "/p", [FUSED_ID])
    assert back.count() == fused.count()


def test_fuse_stored_models(spark, tmpdir_path):
    from quire.plans.pipelines import fuse_stored

    _, vocab, _ = _toy(spark)
    models = init_params(vocab, [0, 1, 2], 2).withColumn("w_1", F.col("model_id").cast("double"))
    write_params(models, tmpdir_path + "/regions")
    fused = fuse_stored(spark, tmpdir_path + "/regions", None, vocab, 2, weights=[1, 1, 1])
    body = {r.w_1 for r in fused.filter("part = 'body'").collect()}
    assert body == {1.0}  # (0 + 1 + 2) / 3
    with pytest.raises(ValueError):
        fuse_stored(spark, tmpdir_path + "/regions", None, vocab, 2, weights=[1, 1]).collect()


def test_model_without_dev_rows_keeps_its_last_epoch(spark):
    _, vocab, store = _toy(spark)
    both = store.withColumn("model_id", F.when(F.col("doc_id") <= 2, 0).otherwise(1))
    res = fit(init_params(vocab, [0, 1], 2), both, 2, 2.0, 3, both.filter("model_id = 0"))
    assert {r.model_id for r in res.params.collect()} == {0, 1} and res.best_epoch[1] == 3
    assert [(r.epoch, r.dev_loss) for r in res.history.collect() if r.model_id == 1 and r.best] == [(3, None)]


def test_residual_is_computed_once_and_only_one_split_is_read(spark):
    from quire.plans.pipelines import FusedConfig, FusedPlan

    plan = FusedPlan(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), FusedConfig(epochs=1))
    region = F.col("region")
    step = gradient_step(init_params(plan.vocab, [0, 1, 2], plan.k), plan.samples("train", region), plan.k, 1.0, plan.vocab_rows * 3)
    text = step._jdf.queryExecution().executedPlan().toString()
    assert text.count("PartitionFilters: [isnotnull(split") + text.count("split = train") >= 2
    scans = [x for x in text.splitlines() if "FileScan" in x and "quire_" in x]
    # logits, residual rows, sample counts: each reads the bucketed store of the train split only
    assert len(scans) == 3 and all("split#" in x and "= train" in x for x in scans)
    assert "doc_id" not in "".join(x for x in text.splitlines() if "Exchange hashpartitioning(doc_id" in x)


@pytest.mark.parametrize("weights", [[(0, 2.0)], [(0, 2.0), (1, 1.0), (7, 1.0)], {0: 1.0}, {0: 1.0, 1: 1.0, 5: 2.0}])
def test_missing_or_surplus_weights_raise(spark, weights):
    p = vec_params(spark, [(0, 0, 1.0), (1, 0, 3.0)])
    w = spark.createDataFrame(weights, "model_id int, weight double") if isinstance(weights, list) else weights
    with pytest.raises(ValueError, match="weights for"):
        average_models(p, ["pos"], ["value"], weights=w).collect()


def test_long_terms_are_not_broadcast(spark, monkeypatch):
    """The bytes of the terms count, not their number alone: the same rows fit or not by their length."""
    from quire.functions import joins

    monkeypatch.setattr(joins, "BROADCAST_MAX_BYTES", 100_000)
    terms = lambda n: spark.range(3).select(F.rpad(F.col("id").cast("string"), n, "x").alias("term"), F.col("id").alias("term_id"))
    rows, row_bytes = measure(terms(50_000), "term")
    assert rows == 3 and 50_000 <= row_bytes < 50_200
    assert not fits_broadcast(rows, row_bytes)
    assert fits_broadcast(*measure(terms(5_000), "term"))


def test_blocks_average_like_single_parameters(spark):
    rows = [(m, g, [float((m * 7 + i * i) % 13) for i in range(n)]) for g, n in (("a", 10), ("b", 4)) for m in range(5)]
    models = spark.createDataFrame(rows, "model_id int, g string, vec array<float>")
    single = models.select("model_id", "g", F.posexplode("vec").alias("pos", "value")).withColumn("value", F.col("value").cast("double"))
    for weights in (None, {m: 1.0 + m for m in range(5)}):
        want = sorted(map(tuple, average_models(single, ["pos"], ["value"], group_cols=["g"], weights=weights).select("g", "pos", "value").collect()))
        blocks = to_blocks(models, "vec", ["model_id", "g"], 4)
        assert blocks.count() == 5 * (3 + 1)
        out = average_blocks(blocks, group_cols=["g"], weights=weights, block=4)
        assert sorted(len(r.vals) for r in out.collect()) == [2, 4, 4, 4]
        got = sorted(map(tuple, from_blocks(out, ["g"], 4).collect()))
        assert [x[:2] for x in got] == [x[:2] for x in want] and [x[2] for x in got] == pytest.approx([x[2] for x in want])


def test_writing_a_model_leaves_the_others(spark, tmpdir_path):
    p = vec_params(spark, [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0)])
    write_params(p, f"{tmpdir_path}/m")
    write_params(vec_params(spark, [(2, 0, 4.0)]), f"{tmpdir_path}/m")
    write_params(vec_params(spark, [(0, 0, 9.0)]), f"{tmpdir_path}/m")
    got = sorted((r.model_id, r.value) for r in read_params(spark, f"{tmpdir_path}/m").collect())
    assert got == [(0, 9.0), (1, 3.0), (2, 4.0)]


def test_argmax_of_many_classes(spark):
    row = spark.range(1).select(*[F.lit(float((c * 37) % 101)).alias(f"p_{c}") for c in range(200)])
    want = max(range(200), key=lambda c: ((c * 37) % 101, -c))
    assert row.select(argmax_first([F.col(f"p_{c}") for c in range(200)]).alias("a")).first().a == want


def test_shuffle_paths_give_the_same_models(spark, monkeypatch):
    from quire.functions import joins

    _, vocab, store = _toy(spark)
    run = lambda: sorted(map(tuple, gradient_step(init_params(vocab, [0], 2), store, 2, 1.0).collect()))
    small = run()
    monkeypatch.setattr(joins, "BROADCAST_MAX_ROWS", 0)
    for a, b in zip(run(), small):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:])


def test_term_buckets_give_the_same_models(spark, monkeypatch):
    """Beyond the broadcast limits: equal results, and the weights join has no exchange below it."""
    from quire.functions import joins
    from quire.operators import train

    _, vocab, store = _toy(spark)
    init = init_params(vocab, [0], 2)
    want = fit(init, store, 2, 1.0, 2, store)
    monkeypatch.setattr(joins, "BROADCAST_MAX_ROWS", 0)
    monkeypatch.setattr(train, "TERM_ROWS", 1)  # terms of two chunks have two salts
    got = fit(init, store, 2, 1.0, 2, store, body_rows=vocab.count(), n_parts=4)
    for a, b in zip(sorted(map(tuple, got.params.collect())), sorted(map(tuple, want.params.collect()))):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:])
    a, b = (sorted((r.epoch, r.best, round(r.dev_loss, 12)) for r in x.history.collect()) for x in (got, want))
    assert a == b
    terms = term_store(store, 4)
    assert terms.hot.count() > 0 and terms.rows.agg(F.max("salt")).first()[0] > 0
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = terms.rows.join(term_weights(init, terms, 2), train.TERM_KEY)
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        whole = logits_by_term(store, init, term_weights(init, terms, 2), terms, 2, ["label_idx"])
        # only partial logits move (the head is a broadcast): one hash exchange in the plan
        assert whole._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_adam_step_matches_numpy(spark):
    counts, vocab, store = _toy(spark)
    params = with_moments(init_params(vocab, [0], 2), 2)
    for step in (1, 2):
        params = adam_step(params, store, 2, 0.1, step)
    terms = sorted(r.term for r in vocab.collect())
    X = np.ones((4, len(terms) + 1))
    X[:, :-1] = 0
    for r in counts.collect():
        X[r.doc_id - 1, terms.index(r.term)] = r.tf
    Y = np.eye(2)[[0, 1, 0, 1]]
    w, m, v = np.zeros((3, len(terms) + 1, 2))
    for step in (1, 2):
        p = np.exp(X @ w) / np.exp(X @ w).sum(1, keepdims=True)
        g = X.T @ (p - Y) / 4
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    got = {r.param: (r.w_0, r.w_1) for r in params.collect()}
    for i, t in enumerate([*terms, "bias"]):
        assert got[t] == pytest.approx(tuple(w[i]))


def test_batches_reach_a_lower_loss_in_equal_passes(spark):
    from quire.plans.pipelines import FusedConfig, FusedPlan

    plan = FusedPlan(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), FusedConfig(epochs=2))
    full = {r.model_id: r.dev_loss for r in plan.region_fit.history.collect() if r.best}
    rows = plan.batch_fit.history.collect()
    assert {r.step for r in rows} == {2, 4, 6, 8} and sum(r.best for r in rows) == 3
    best = {r.model_id: r.dev_loss for r in rows if r.best}
    assert all(best[m] == min(r.dev_loss for r in rows if r.model_id == m) for m in best)
    assert all(best[m] < full[m] for m in full)
    sizes = dict(map(tuple, plan.samples("train", F.col("region")).groupBy(batch_of(4)).count().collect()))
    assert sorted(sizes) == [0, 1, 2, 3] and min(sizes.values()) > max(sizes.values()) / 3


def local_chunks(spark, n=60):
    """Two models' chunks over six terms, one chunk without a term and one without a label."""
    rng = np.random.default_rng(2)
    rows = [(i, i % 2, 0, i % 2, None if i == 7 else int(rng.integers(3)),
             [] if i == 4 else [(int(t), float(rng.random())) for t in sorted(rng.choice(6, size=3, replace=False))]) for i in range(n)]
    schema = "doc_id long, region int, sub int, model_id int, label_idx int, feats array<struct<term_id:bigint,tf:double>>"
    vocab = spark.createDataFrame([(f"t{i}", i) for i in range(6)], "term string, term_id long")
    return rows, spark.createDataFrame(rows, schema).repartition(3), init_params(vocab, [0, 1, 2], 3)


def test_local_steps_against_brute_force(spark):
    """Shards, batches and averages by whole parameter arrays, in another order of work."""
    rows, chunks, params = local_chunks(spark)
    kept = {r.doc_id: (r.s, r.b) for r in chunks.select("doc_id", batch_of(3, 778).alias("s"), batch_of(2).alias("b")).collect()}
    w = np.zeros((3, 7, 3))  # model, term or head, class
    for _ in range(2):
        copies = []
        for shard in range(3):
            c = w.copy()
            for b in range(2):
                g, n = np.zeros_like(c), np.zeros(3)
                for i, _, _, m, y, feats in rows:
                    if y is not None and kept[i] == (shard, b):
                        x = np.zeros(7)
                        x[6] = 1.0
                        for t, tf in feats:
                            x[t] = tf
                        p = np.exp(x @ c[m])
                        g[m] += np.outer(x, p / p.sum() - np.eye(3)[y])
                        n[m] += 1
                c -= 2.0 * g / np.maximum(n, 1)[:, None, None]
            copies.append(c)
        w = np.mean(copies, axis=0)
    fitted = fit_local(params, chunks, 3, 2.0, 2, 2, chunks.limit(0), 4, 21, shard_rows=20)
    got = fitted.params.collect()
    assert len(got) == 21 and fitted.history.count() == 0
    for r in got:
        assert [r.w_0, r.w_1, r.w_2] == pytest.approx(list(w[r.model_id, 6 if r.part == "head" else r.param_id]), abs=1e-12)


def test_local_steps_beyond_the_broadcast_limits(spark, monkeypatch):
    """Weights joined by shuffle give the same models."""
    from quire.functions import joins

    _, chunks, params = local_chunks(spark)
    fitted = [fit_local(params, chunks, 3, 2.0, 2, 2, chunks, 4, 21, shard_rows=20)]
    monkeypatch.setattr(joins, "BROADCAST_MAX_ROWS", 0)
    fitted.append(fit_local(params, chunks, 3, 2.0, 2, 2, chunks, 4, 21, shard_rows=20))
    small, large = ({(r.model_id, r.param_id): (r.w_0, r.w_1, r.w_2) for r in f.params.collect()} for f in fitted)
    assert large == {k: pytest.approx(v) for k, v in small.items()}


def test_one_shard_and_batch_is_a_gradient_step(spark):
    _, chunks, params = local_chunks(spark)
    values = lambda df: {(r.model_id, r.param_id): pytest.approx((r.w_0, r.w_1, r.w_2)) for r in df.collect()}
    whole = gradient_step(params, chunks.where("label_idx IS NOT NULL"), 3, 1.5, 21)
    fitted = fit_local(params, chunks, 3, 1.5, 1, 1, chunks, 4, 21, shard_rows=1000)
    assert {k: v for k, v in values(whole).items()} == {(r.model_id, r.param_id): (r.w_0, r.w_1, r.w_2) for r in fitted.params.collect()}
    assert [(r.model_id, r.step, r.best) for r in fitted.history.orderBy("model_id").collect()] == [(0, 1, True), (1, 1, True)]
    none = fit_local(params, chunks.limit(0), 3, 1.5, 1, 2, chunks, 4, 21)
    assert all(r.w_0 == r.w_1 == r.w_2 == 0 for r in none.params.collect())


def test_local_rounds_reach_a_lower_loss_in_equal_passes(spark):
    from quire.plans.pipelines import FusedConfig, FusedPlan

    plan = FusedPlan(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), FusedConfig(epochs=2, shard_rows=100))
    full = {r.model_id: r.dev_loss for r in plan.region_fit.history.collect() if r.best}
    best = {r.model_id: r.dev_loss for r in plan.local_fit.history.collect() if r.best}
    assert set(best) == set(full) and all(best[m] < full[m] for m in full)
