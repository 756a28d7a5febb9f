"""Label dictionary: fit on train, encode (unseen -> null), decode."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.joins import broadcast_if_small


def fit_label_map(train: DataFrame, label_col: str = "label") -> DataFrame:
    """``(label, label_idx)``: distinct non-null labels of ``train`` in ascending
    order, numbered from 0.  The distinct set is the classifier's output width
    (a handful to thousands of classes), so numbering it in one task is safe;
    the distinct itself is a partial aggregation over the whole corpus."""
    labels = train.select(F.col(label_col).alias("label")).filter(F.col("label").isNotNull()).distinct()
    return labels.select("label", (F.row_number().over(Window.orderBy("label")) - 1).cast("int").alias("label_idx"))


def encode_labels(df: DataFrame, label_map: DataFrame, label_col: str = "label", out: str = "label_idx",
                  k: int | None = None) -> DataFrame:
    """Left lookup of each label's index; labels missing from the map give null."""
    m = label_map.select(F.col("label").alias("__lab"), F.col("label_idx").alias(out))
    m = broadcast_if_small(m, k)
    return df.join(m, df[label_col] == m["__lab"], "left").drop("__lab")


def decode_labels(df: DataFrame, label_map: DataFrame, idx_col: str = "prediction_idx", out: str = "prediction",
                  k: int | None = None) -> DataFrame:
    """Left lookup of the label of an index; unknown indexes give null."""
    m = label_map.select(F.col("label_idx").alias("__idx"), F.col("label").alias(out))
    m = broadcast_if_small(m, k)
    return df.join(m, df[idx_col] == m["__idx"], "left").drop("__idx")


def sorted_encoder(df: DataFrame, label_col: str = "label", out: str = "label_idx"):
    """Library encoder with sorted classes (refit per call).  Returns the
    encoded frame and a decode function that raises on unknown codes."""
    from pyspark.ml.feature import IndexToString, StringIndexer

    model = StringIndexer(inputCol=label_col, outputCol="__idx", stringOrderType="alphabetAsc",
                          handleInvalid="error").fit(df)
    classes = list(model.labels)
    encoded = model.transform(df).withColumn(out, F.col("__idx").cast("int")).drop("__idx")

    def decode(frame: DataFrame, idx_col: str = out, dst: str = "decoded") -> DataFrame:
        bad = frame.filter((F.col(idx_col) < 0) | (F.col(idx_col) >= len(classes)) | F.col(idx_col).isNull())
        if not bad.isEmpty():
            raise ValueError("codes outside the fitted classes")
        conv = IndexToString(inputCol="__d", outputCol=dst, labels=classes)
        return conv.transform(frame.withColumn("__d", F.col(idx_col).cast("double"))).drop("__d")

    return encoded, decode
