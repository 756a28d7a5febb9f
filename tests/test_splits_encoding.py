import math

import pytest
from pyspark.sql import functions as F

from quire.operators.encoding import decode_labels, encode_labels, fit_label_map, sorted_encoder
from quire.operators.splits import exact_split, hash_split, split_recipe


def docs(spark, n):
    return spark.range(n).select(F.col("id").alias("doc_id"))


@pytest.mark.parametrize("n,frac", [(1, 0.2), (7, 0.5), (1000, 0.2), (999, 0.5), (10, 0.0)])
def test_exact_split_sizes(spark, n, frac):
    out = exact_split(docs(spark, n), frac)
    counts = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert counts.get("test", 0) == math.ceil(n * frac)
    assert sum(counts.values()) == n


def test_exact_split_takes_smallest_keys(spark):
    out = exact_split(docs(spark, 300), 0.2).withColumn("k", F.md5(F.concat(F.lit("777:"), F.col("doc_id").cast("string"))))
    test_max = out.filter("split = 'test'").agg(F.max("k")).first()[0]
    train_min = out.filter("split = 'train'").agg(F.min("k")).first()[0]
    assert test_max < train_min


def test_exact_split_keeps_repeated_ids_together(spark):
    repeated = docs(spark, 90).select(F.explode(F.array_repeat("doc_id", 3)).alias("doc_id"))
    out = exact_split(repeated, 0.2)
    parts = out.groupBy("doc_id").agg(F.collect_set("split").alias("s")).collect()
    assert all(len(r.s) == 1 for r in parts)
    assert out.filter("split = 'test'").count() == 54
    one = docs(spark, 1).select(F.explode(F.array_repeat("doc_id", 5)).alias("doc_id"))
    assert exact_split(one, 0.2).filter("split = 'test'").count() == 5


def test_recipes_cover_and_disjoint(spark):
    d = docs(spark, 500)
    for name in ["news", "cases", "crisis", "paragraph", "flagged"]:
        out = split_recipe(d, name)
        assert out.count() == 500 and out.select("doc_id").distinct().count() == 500
    news = {r.split: r["count"] for r in split_recipe(d, "news").groupBy("split").count().collect()}
    assert news["test"] == 100 and news["finetune"] + news["dev"] == 80 and news["dev"] == 40
    with pytest.raises(ValueError):
        split_recipe(d, "nope")


def test_hash_split_is_narrow_and_stable(spark):
    a = hash_split(docs(spark, 200), 0.2).collect()
    b = hash_split(docs(spark, 200).repartition(7), 0.2).collect()
    assert sorted(a) == sorted(b)


def test_label_map_unseen_and_decode(spark):
    train = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "label string")
    m = fit_label_map(train)
    assert sorted((r.label, r.label_idx) for r in m.collect()) == [("a", 0), ("b", 1)]
    dev = spark.createDataFrame([(1, "a"), (2, "zzz")], "doc_id long, label string")
    enc = {r.doc_id: r.label_idx for r in encode_labels(dev, m).collect()}
    assert enc == {1: 0, 2: None}
    pred = spark.createDataFrame([(1, 1), (2, 7)], "doc_id long, prediction_idx int")
    dec = {r.doc_id: r.prediction for r in decode_labels(pred, m).collect()}
    assert dec == {1: "b", 2: None}


def test_sorted_encoder_raises_on_unknown(spark):
    df = spark.createDataFrame([("x",), ("a",), ("m",)], "label string")
    enc, decode = sorted_encoder(df)
    assert sorted((r.label, r.label_idx) for r in enc.collect()) == [("a", 0), ("m", 1), ("x", 2)]
    back = decode(enc).collect()
    assert all(r.label == r.decoded for r in back)
    with pytest.raises(ValueError):
        decode(spark.createDataFrame([(5,)], "label_idx int"))
