"""Classification metrics from one confusion table.

``groupBy(gold, pred).count()`` is the only pass over the predictions; per
label counts come from the gold side and the predicted side joined with a
full outer join, and every metric is one final small aggregation.  Optional
``group_cols`` (e.g. a fold) compute the same per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, gold: str = "gold", pred: str = "prediction", group_cols: Sequence[str] = ()) -> DataFrame:
    return (df.select(*group_cols, F.col(gold).cast("string").alias("gold"), F.col(pred).cast("string").alias("pred"))
            .groupBy(*group_cols, "gold", "pred").agg(F.count(F.lit(1)).alias("n")))


def per_label(conf: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """``group + [label, support, n_pred, tp, precision, recall, f1]`` for every
    label seen in gold or prediction."""
    g = list(group_cols)
    gold_side = conf.groupBy(*g, F.col("gold").alias("label")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"))
    pred_side = conf.groupBy(*g, F.col("pred").alias("label")).agg(F.sum("n").alias("n_pred"))
    a, b = gold_side.alias("a"), pred_side.alias("b")
    cond = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in g + ["label"]]
    j = a.join(b, cond, "full_outer").select(
        *[F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c in g + ["label"]],
        F.coalesce(F.col("a.support"), F.lit(0)).alias("support"),
        F.coalesce(F.col("b.n_pred"), F.lit(0)).alias("n_pred"),
        F.coalesce(F.col("a.tp"), F.lit(0)).alias("tp"))
    prec = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    f1 = F.when(F.col("support") + F.col("n_pred") > 0,
                2.0 * F.col("tp") / (F.col("support") + F.col("n_pred"))).otherwise(0.0)
    return j.select(*g, "label", "support", "n_pred", "tp", prec.alias("precision"), rec.alias("recall"), f1.alias("f1"))


def metrics(df: DataFrame, gold: str = "gold", pred: str = "prediction", group_cols: Sequence[str] = ()) -> DataFrame:
    """``group + [n, accuracy, weighted_precision, weighted_recall, weighted_f1, macro_f1, micro_f1]``.

    Weighted = support-weighted mean over labels; macro = plain mean over
    labels seen in gold or prediction; micro F1 equals accuracy for
    single-label data.
    """
    g = list(group_cols)
    lab = per_label(confusion(df, gold, pred, g), g)
    n = F.sum("support")
    return lab.groupBy(*g).agg(
        n.cast("long").alias("n"),
        (F.sum("tp") / n).alias("accuracy"),
        (F.sum(F.col("precision") * F.col("support")) / n).alias("weighted_precision"),
        (F.sum(F.col("recall") * F.col("support")) / n).alias("weighted_recall"),
        (F.sum(F.col("f1") * F.col("support")) / n).alias("weighted_f1"),
        F.avg("f1").alias("macro_f1"),
        (F.sum("tp") / n).alias("micro_f1"),
    )


def fold_summary(per_fold: DataFrame, cols: Sequence[str] = ("macro_f1", "micro_f1")) -> DataFrame:
    """``(metric, mean, std)`` over folds; std is the population deviation."""
    stacked = None
    for c in cols:
        part = per_fold.select(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
        stacked = part if stacked is None else stacked.unionByName(part)
    return stacked.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
