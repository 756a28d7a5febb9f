"""Global row numbering without funnelling all rows through one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.session import cut_lineage


def global_row_number(df: DataFrame, order_col: str, out: str = "rn") -> DataFrame:
    """1-based position of each row in ascending ``order_col`` order.

    Rows are range-partitioned on the key and written to the checkpoint folder
    (so partition ids are stable), each partition counts its rows, a per-
    partition offset table (one row per partition: bounded, safe to broadcast)
    is cumulated, and rows are numbered inside their own partition.  Keys are
    expected to be unique (e.g. the distinct terms of a vocabulary).
    """
    ranged = cut_lineage(df.repartitionByRange(order_col).withColumn("__pid", F.spark_partition_id()))
    counts = ranged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__pid", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    inside = Window.partitionBy("__pid").orderBy(order_col)
    return (ranged.join(F.broadcast(offsets), "__pid")
            .withColumn(out, (F.row_number().over(inside) + F.col("__off")).cast("long"))
            .drop("__pid", "__off"))
