"""Benchmark: headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries": {name: sec}, "sf"}.
Every query is forced in full with the no-op sink (nothing is collected).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quire.plans import catalog as C  # noqa: E402
from quire.plans.pipelines import FusedConfig, FusedPlan  # noqa: E402
from quire.session import build_session, table  # noqa: E402


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", app="quire-bench", shuffle_partitions=int(cpus) * 2,
                          extra={"spark.driver.memory": "16g"})
    timings: dict[str, float] = {}

    def timed(name, fn):
        t0 = time.time()
        run(fn())
        timings[name] = round(time.time() - t0, 3)

    # warm the JVM and file listing once (not timed)
    table(spark, sf_dir, "documents").limit(1).collect()

    timed("length_bands", lambda: C.q_length_bands(spark, sf_dir))
    timed("chunk_histogram", lambda: C.q_chunk_histogram(spark, sf_dir))
    timed("region_chunks", lambda: C.q_region_chunks(spark, sf_dir))
    timed("char_chunks", lambda: C.q_char_chunks(spark, sf_dir))
    timed("recipe_news", lambda: C._recipe("news")(spark, sf_dir))
    timed("token_windows", lambda: C.q_token_windows(spark, sf_dir))
    timed("average_models", lambda: C.q_average_models(spark, sf_dir))

    # the full fused pipeline: 3 regions, chunks of at most 400, 3 epochs each phase
    t0 = time.time()
    plan = FusedPlan(table(spark, sf_dir, "documents"), FusedConfig(epochs=3, finetune_epochs=3))
    run(plan.features)
    timings["fused_run_prepare"] = round(time.time() - t0, 3)
    t1 = time.time()
    run(plan.region_fit.params)
    timings["fused_run_region_fit"] = round(time.time() - t1, 3)
    t1 = time.time()
    run(plan.finetune_fit.params)
    timings["fused_run_fuse_finetune"] = round(time.time() - t1, 3)
    t1 = time.time()
    m = plan.metrics().collect()[0]
    timings["fused_run_score_metrics"] = round(time.time() - t1, 3)
    timings["fused_run_total"] = round(time.time() - t0, 3)

    sf = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "total_query_seconds",
        "value": round(sum(v for k, v in timings.items() if k != "fused_run_total"), 3),
        "unit": "sec",
        "queries": timings,
        "sf": float(sf.group(1)) if sf else None,
        "fused_run_accuracy": round(float(m["accuracy"]), 4),
        "fused_run_macro_f1": round(float(m["macro_f1"]), 4),
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
