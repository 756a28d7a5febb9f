"""Training in shards: the features stay, only weights and gradients of distinct terms move."""

import pytest
from pyspark.sql import functions as F

from quire.operators import features
from quire.operators.features import number_terms, numbered_by_hash, shard_of
from quire.operators.train import by_key, chunk_logits, fit, gradient, init_params, mean_loss, shard_logits, shard_store
from quire.plans.pipelines import FusedConfig, FusedPlan

SCHEMA = "doc_id long, region int, sub int, model_id int, label_idx int, feats array<struct<term_id:bigint,tf:double>>"


def documents(spark, n=60):
    words = ["red", "blue", "green", "stone", "river", "cloud", "iron"]
    rows = [(i, " ".join(words[(i * j) % 7] for j in range(1, 12)) + f" only{i}", "ab"[i % 2]) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def values(df):
    return {tuple(r)[:4]: pytest.approx(tuple(r)[4:]) for r in df.collect()}


def test_only_weights_and_gradients_move(spark):
    """Two exchanges a step, whatever the number of weights: no feature row is in them."""
    plan = FusedPlan(documents(spark), FusedConfig(epochs=1), n_parts=4)
    region = F.col("region")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        store = shard_store(plan.dealt("train", region), 4)
        params = by_key(init_params(plan.vocab, [0, 1, 2], plan.k), 4)
        text = gradient(params, store.rows, plan.k, store=store)._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange hashpartitioning") == 2
        assert "doc_id" not in "".join(x for x in text.splitlines() if "Exchange" in x)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_a_bucket_holds_one_shard(spark):
    dealt = spark.range(2000).select(shard_of(F.col("id"), 7, spark).alias("s")).groupBy("s").count()
    assert dealt.count() == 7 and dealt.select(F.pmod(F.hash("s"), F.lit(7)).alias("b")).distinct().count() == 7


def test_terms_that_share_a_hash_keep_ids_of_their_own(spark, monkeypatch):
    """Where hashes clash the ids are dense numbers, and the models are the same."""
    docs = documents(spark)
    want = FusedPlan(docs, FusedConfig(epochs=1, finetune_epochs=1), n_parts=3)
    assert numbered_by_hash(want.dictionary)
    first = values(want.finetune_fit.params)
    monkeypatch.setattr(features, "term_hash", lambda term: F.length(term).cast("long"))
    plan = FusedPlan(docs, FusedConfig(epochs=1, finetune_epochs=1), n_parts=3)
    assert not numbered_by_hash(plan.dictionary) and plan.dictionary.select("term_id").distinct().count() == plan.dictionary.count()
    got = {k[:3]: v for k, v in values(plan.finetune_fit.params).items()}
    assert got == {k[:3]: v.expected for k, v in first.items()}
    vocab = spark.createDataFrame([("a",), ("b",), ("cc",)], "term string")
    assert sorted(r.term_id for r in number_terms(vocab).collect()) == [1, 2, 3]


def test_shards_give_the_rows_of_the_joins(spark):
    """Repeated chunks, chunks without a document or a term, and labels that differ within a repeated chunk."""
    feats = lambda i: [(t, 0.25 + (i * t % 5) / 8) for t in range(i % 4)]
    # a repeated chunk's rows hold the terms of all of them in the joined store
    single = [(i, i % 2, 0, i % 2, i % 3, feats(i)) for i in range(20)]
    twice = [(100, 0, 0, 0, 1), (100, 0, 0, 0, 1), (101, 1, 0, 1, 0), (101, 1, 0, 1, 2)]
    by_join = spark.createDataFrame(single + [(*r, feats(3) + feats(3)) for r in twice] + [(None, 0, 0, 0, 1, None)] * 2, SCHEMA)
    by_shard = spark.createDataFrame(single + [(*r, feats(3)) for r in twice] + [(None, 0, 0, 0, 1, feats(3))] * 2, SCHEMA)
    vocab = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "term string, term_id long")
    params = init_params(vocab, [0, 1], 3).withColumn("w_1", F.col("param_id") * 0.3 + 0.1).withColumn("w_2", F.lit(-0.2))
    store = shard_store(by_shard, 3)
    stored = by_key(params, 3)
    key = lambda df: {tuple(r)[:2]: pytest.approx(tuple(r)[2:]) for r in df.collect()}
    want = key(gradient(params, by_join, 3))
    got = {tuple(r)[:2]: tuple(r)[2:] for r in gradient(stored, by_shard, 3, store=store).collect()}
    assert got == want
    loss = {r.model_id: (r.n, pytest.approx(r.loss)) for r in mean_loss(params, by_join, 3).collect()}
    assert {r.model_id: (r.n, r.loss) for r in mean_loss(stored, by_shard, 3, store=store).collect()} == loss
    scores = values(chunk_logits(by_join, params, 3))
    assert {tuple(r)[:4]: tuple(r)[4:] for r in shard_logits(stored, store, 3).collect()} == scores


def test_fit_in_shards_is_fit_by_joins(spark):
    rows = [(i, 0, 0, i % 2, i % 3, [(t, 0.5) for t in range(i % 5)]) for i in range(40)]
    chunks = spark.createDataFrame(rows, SCHEMA)
    init = init_params(spark.createDataFrame([(f"t{i}", i) for i in range(5)], "term string, term_id long"), [0, 1], 3)
    a, b = fit(init, chunks, 3, 1.0, 2, chunks), fit(init, chunks, 3, 1.0, 2, chunks, n_parts=3)
    assert {tuple(r)[:4]: tuple(r)[4:] for r in b.params.collect()} == values(a.params) and a.best_epoch == b.best_epoch


def test_a_word_of_many_documents_meets_the_vocabulary_once(spark):
    """Windows of two shards: repeated documents, empty words, words without an id, null and empty texts."""
    from quire.operators.chunking import token_windows

    rows = [(1, "a b a"), (1, "a b a"), (2, " a  "), (3, None), (4, ""), (5, "x"), (6, "b x a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    vocab = spark.createDataFrame([("", 1000), ("a", 1001), ("b", 1002)], "term string, term_id long")
    out = token_windows(docs, vocab, body_len=2, n_parts=2)
    got = sorted((r.doc_id, r.win, [i for i, m in zip(r.input_ids, r.attention_mask) if m]) for r in out.collect())
    a = [(1, 0, [101, 1001, 1002, 102]), (1, 1, [101, 1001, 102])]
    assert got == sorted([*a, *a, (2, 0, [101, 1000, 1001, 102]), (2, 1, [101, 1000, 1000, 102]), (4, 0, [101, 1000, 102]),
                          (6, 0, [101, 1002, 1001, 102]), (6, 1, [101, 1002, 102])])
    assert all(len(r.input_ids) == len(r.attention_mask) == 512 for r in out.collect())
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "collect_list" not in plan


def test_terms_of_many_rows_are_counted_together(spark, monkeypatch):
    """Counted by numbers, a batch of rows at a time: null, empty and repeated texts, texts without a term, and portions."""
    import math
    from collections import Counter

    monkeypatch.setattr(features, "COUNT_BYTES", 16)
    texts = [None, "", " -- ", "b a B", "b a B", "\u00c9t\u00e9 d'\u00e9t\u00e9, \u65e5\u672c 12 x\u00b2\U0001f600y", "a " * 300 + "z", "_a_a-b"]
    chunks = spark.createDataFrame([(i, 0, 0, t) for i, t in enumerate(texts)], "doc_id long, region int, sub int, chunk string")
    out = features.chunk_terms(chunks)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "sort_array" not in plan
    assert out.dtypes[-1] == ("terms", "array<struct<term:string,cnt:bigint,tf:double>>")
    words = [[], [], ["b", "a", "b"], ["b", "a", "b"], ["\u00e9t\u00e9", "d", "\u00e9t\u00e9", "\u65e5\u672c", "12", "x\u00b2", "y"], ["a"] * 300 + ["z"], ["a", "a", "b"]]
    got = {r.doc_id: r.terms for r in out.collect()}
    assert got.pop(0) is None
    for i, w in enumerate(words, start=1):
        held = Counter(w)
        norm = math.sqrt(sum(n * n for n in held.values()))
        assert [tuple(t) for t in got[i]] == [(t, held[t], held[t] / norm) for t in sorted(held, key=str.encode)]


def test_terms_move_once(spark):
    """The texts are dealt to their shards; the terms counted there are written as they lie, a file per shard and split."""
    plan = FusedPlan(documents(spark), FusedConfig(epochs=1), n_parts=4)
    assert len(plan.terms.inputFiles()) == plan.terms.select("shard", "split").distinct().count()


def test_one_region_without_a_limit_is_the_text(spark):
    from quire.operators.chunking import chunk_documents

    docs = spark.createDataFrame([(1, "a  b "), (2, ""), (3, None), (4, " "), (4, " ")], "doc_id long, text string")
    out = chunk_documents(docs, "text", 1, None)
    assert sorted(map(tuple, out.collect()), key=str) == [(1, 0, 0, "a  b "), (2, 0, 0, ""), (3, 0, 0, None), (4, 0, 0, " "), (4, 0, 0, " ")]
    assert out.dtypes[1:3] == [("region", "int"), ("sub", "int")]
    assert "split" not in out._jdf.queryExecution().optimizedPlan().toString()
