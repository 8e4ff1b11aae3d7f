"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs once to warm up and once timed, with all result rows and columns
computed (noop sink).
"""

from __future__ import annotations

import json
import os
import sys
import time

from loadline.registry.queries import QUERIES, forget_models
from loadline.plans.staging import remove_staged
from loadline.session import build_session
from loadline.sources.events import readings

HEADLINE = [
    "state_share", "session_overview", "sample_rate", "context_join", "sliding_windows",
    "window_time_features", "window_validation", "dataset_validation", "spectral_features",
    "window_features", "rag_classification", "window_analysis", "state_segments", "run_length",
    "smooth_labels_simultaneous", "smooth_labels_leftmost", "cycle_position", "cycle_features_runs",
    "job_clusters", "lookback_windows", "class_report",
]
#: Timed as well, outside the total.
MORE = ["lookback_moments", "window_context", "confidence_histogram", "job_cluster_summary", "ml_training_history", "ml_prediction_check", "ml_range",
        "registry_load", "streaming_windows"]


def run(query, spark, sf_dir) -> float:
    start = time.time()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.time() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(cpus)
    names = sys.argv[1:] or HEADLINE
    start = time.time()
    readings(spark, sf_dir)  # the derived log is written once, as a loader would
    build = round(time.time() - start, 3)
    for name in names:
        run(QUERIES[name], spark, sf_dir)
    seconds = {name: run(QUERIES[name], spark, sf_dir) for name in names}
    more = {}
    for name in [] if sys.argv[1:] else MORE:  # once each, first run
        forget_models()
        more[name] = run(QUERIES[name], spark, sf_dir)
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "build_readings": build, "first_runs": more, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus}))
    remove_staged(spark)


if __name__ == "__main__":
    main()
