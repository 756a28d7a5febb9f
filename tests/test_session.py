import os
import tempfile

from quire.session import cut_lineage, drop_stored, ensure_checkpoint_dir, store_bucketed


def test_stored_tables_can_be_dropped(spark):
    own = spark.newSession()
    sc, before = spark.sparkContext, ensure_checkpoint_dir(spark)
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="quire-drop-"))
    try:
        folder = sc.getCheckpointDir().replace("file:", "")
        df = own.range(100).selectExpr("id", "id % 7 AS k")
        assert cut_lineage(df, ("k",)).where("k = 3").count() == 14
        b = store_bucketed(df, 4, ["k"])
        assert b.columns == ["id", "k"] and "Exchange" not in b.groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
        assert len(os.listdir(os.path.join(folder, "quire-tables"))) == 2
        drop_stored(own)
        assert not os.path.exists(os.path.join(folder, "quire-tables"))
    finally:
        sc.setCheckpointDir(os.path.dirname(before.replace("file:", "")))
