from pyspark.sql import functions as F

from quire.functions.joins import broadcast_if_small, fits_broadcast
from quire.functions.ranking import global_row_number
from quire.operators.features import partitions_for


def test_global_row_number_matches_sorted_order(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).cast("string").alias("term")).distinct()
    got = {r.term: r.rn for r in global_row_number(df, "term").collect()}
    want = {t: i + 1 for i, t in enumerate(sorted(got))}
    assert got == want


def test_broadcast_checks_and_partition_count(spark):
    assert fits_broadcast(10) and not fits_broadcast(10**9)
    small = spark.range(3)
    assert broadcast_if_small(small).count() == 3
    n = partitions_for(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert n == spark.sparkContext.defaultParallelism  # small files: one bucket per core; no upper limit otherwise
