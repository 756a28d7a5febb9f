import pytest
from pyspark.sql import functions as F

from quire.functions.arrays import argmax_first, softmax
from quire.operators.metrics import fold_summary, metrics, per_label
from quire.operators.metrics import confusion
from quire.operators.score import attach_gold, binary_threshold, doc_max_vote, parse_generated
from quire.operators.training_sets import prediction_prompt, prompt_rows


def test_softmax_and_argmax(spark):
    df = spark.createDataFrame([(0.5, 0.5), (1000.0, 0.0), (-3.0, 2.0)], "a double, b double")
    cols = [F.col("a"), F.col("b")]
    rows = df.select(*[c.alias(f"p{i}") for i, c in enumerate(softmax(cols))], argmax_first(cols).alias("am"),
                     binary_threshold("a", "b").alias("bt")).collect()
    assert [r.am for r in rows] == [0, 0, 1]        # tie: first class
    assert [r.bt for r in rows] == [1, 0, 1]        # tie: class 1
    assert all(r.p0 + r.p1 == pytest.approx(1.0) for r in rows)


def test_parse_generated_and_vote(spark):
    df = spark.createDataFrame([(1, "1"), (1, " 1 "), (1, "yes"), (1, "1.0"), (2, "1_0"), (2, "+3"), (3, "no")],
                               "doc_id long, generated string")
    got = sorted((r.doc_id, r.prediction) for r in parse_generated(df).collect())
    assert got == [(1, 1), (1, 1), (2, 3), (2, 10)]
    votes = {r.doc_id: r.prediction for r in doc_max_vote(parse_generated(df)).collect()}
    assert votes == {1: 1, 2: 10}        # document 3 has no valid answer and vanishes


def test_metrics_reference_case(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 2)], "gold int, prediction int")
    m = metrics(df).first()
    assert m.accuracy == pytest.approx(0.5)
    assert m.micro_f1 == pytest.approx(0.5)
    assert m.weighted_precision == pytest.approx(0.75)
    assert m.weighted_recall == pytest.approx(0.5)
    assert m.weighted_f1 == pytest.approx(0.583333, abs=1e-5)
    assert m.macro_f1 == pytest.approx(0.388889, abs=1e-5)
    labels = {r.label: (r.support, r.n_pred, r.tp) for r in per_label(confusion(df)).collect()}
    assert labels == {"0": (2, 1, 1), "1": (2, 2, 1), "2": (0, 1, 0)}


def test_metrics_agree_with_library_evaluator(spark):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator

    df = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (2.0, 0.0)],
                               "gold double, prediction double")
    m = metrics(df).first()
    ev = MulticlassClassificationEvaluator(labelCol="gold", predictionCol="prediction")
    for name, col in [("f1", "weighted_f1"), ("accuracy", "accuracy"), ("weightedPrecision", "weighted_precision"),
                      ("weightedRecall", "weighted_recall")]:
        assert ev.setMetricName(name).evaluate(df) == pytest.approx(m[col])


def test_fold_summary_population_std(spark):
    per_fold = spark.createDataFrame([(0, 0.5, 0.5), (1, 0.7, 0.7)], "fold int, macro_f1 double, micro_f1 double")
    got = {r.metric: (r.mean, r.std) for r in fold_summary(per_fold).collect()}
    assert got["macro_f1"] == pytest.approx((0.6, 0.1))


def test_prompts(spark):
    df = spark.createDataFrame([("The bridge opened in spring", 1), ("No boat ever reached the mill", 0)], "text string, labels int")
    rows = prompt_rows(df).collect()
    assert rows[0].prefix == "binary classification" and rows[0].target_text == "1"
    p = df.select(prediction_prompt("text").alias("p")).first().p
    assert p == "binary classification:The bridge opened in spring"


def test_first_gold_match_counts(spark):
    docs = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "doc_id long, prediction string")
    rows = [(1, 5, "late"), (1, 2, "first"), (1, 9, "last"), (2, 1, None), (2, 3, "b"), (4, 1, "no document")]
    gold = spark.createDataFrame(rows * 3, "doc_id long, at int, label string").repartition(4)
    got = sorted(map(tuple, attach_gold(docs, gold, order_col="at").collect()))
    assert got == [(1, "x", "first"), (2, "y", None)]
    assert [r.gold for r in attach_gold(docs.where("doc_id = 1"), gold).collect()] == ["first"]
