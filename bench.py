"""Benchmark the headline queries; prints ONE JSON line.

env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
     BENCH_QUERIES (optional comma list to override the headline set).
Each query is executed in full with the ``noop`` sink (no collect to the driver).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from retainly.plans.registry import load_all  # noqa: E402
from retainly.session import get_session  # noqa: E402

HEADLINE = [
    "campaign_cost", "budget_allocation", "ab_groups", "auc_exact", "threshold_sweep", "classification_report",
    "describe_numeric", "outlier_iqr_cap", "standard_scale", "pii_counts", "duplicates", "dedup_exact",
    "ks_drift", "mean_shift_drift", "woe_iv", "mutual_information", "stratified_split", "fold_distribution",
    "shapley_global", "group_fairness", "run_ttest", "pipeline_summary", "train_gbt",
    "persist_model", "score_batch",  # fit + save the pipeline, then batch scoring with the saved model
    "stream_score", "stream_drift",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    spark = get_session(f"local[{cpus}]", shuffle_partitions=cpus)
    reg = load_all()
    # warm-up outside the timings: JVM, code generation paths and the file listing cache
    spark.read.parquet(f"{sf_dir.rstrip('/')}/region.parquet").count()
    times: dict[str, float] = {}
    failed: dict[str, str] = {}
    for name in names:
        t0 = time.perf_counter()
        try:
            reg[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t0, 3)
        except Exception as e:  # noqa: BLE001 - report and continue
            failed[name] = f"{type(e).__name__}: {str(e)[:200]}"
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
           "sf": float(sf) if sf.replace(".", "").isdigit() else sf, "cpus": cpus}
    if failed:
        out["failed"] = failed
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
