import os

from pyspark.sql import functions as F

from quire.plans.pipelines import FusedConfig, FusedPlan
from quire.streaming.predict import score_documents, start_prediction_stream

SF = "/root/testdata/sf0.001"


def test_stream_matches_batch(spark, tmpdir_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = FusedPlan(docs, FusedConfig(epochs=1, finetune_epochs=1))
    params = plan.finetune_fit.params
    incoming = os.path.join(tmpdir_path, "incoming")
    test_docs = plan.split_docs.filter("split = 'test'").select("doc_id", "text")
    test_docs.write.parquet(incoming)
    stream = spark.readStream.schema("doc_id long, text string").parquet(incoming)
    q = start_prediction_stream(stream, params, plan.label_map, plan.k, os.path.join(tmpdir_path, "out"),
                                os.path.join(tmpdir_path, "ckpt"))
    q.awaitTermination(300)
    got = {r.doc_id: r.prediction for r in spark.read.parquet(os.path.join(tmpdir_path, "out")).collect()}
    want = {r.doc_id: r.prediction for r in plan.doc_predictions().collect()}
    assert got == want
    direct = {r.doc_id: r.prediction for r in score_documents(test_docs, params, plan.label_map, plan.k).collect()}
    assert direct == want
