"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pulsegrid.plans.registry import registered
from pulsegrid.session import local_session

HEADLINE = (
    "metric_scan_filter", "hourly_resample", "zscore_by_metric", "metric_matrix_fill", "interval_labels", "unlabelled_periods",
    "sliding_windows", "window_labels", "window_overlap_truth", "log_parse", "log_rarity_by_hour", "log_template_merge", "call_bags",
    "detrended_scores", "error_quantile", "threshold_fit", "spot_stream", "drift_spot_stream", "hysteresis_alerts", "segment_metrics",
    "ranking_metrics", "metric_quality", "supervised_split", "one_class_boundary", "reconstruct_errors", "trial_grid",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    known = registered()
    known["metric_ranges"].run(spark, sf_dir).collect()
    took = {}
    for name in sys.argv[1:] or HEADLINE:
        started = time.perf_counter()
        known[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - started, 3)
    spark.stop()
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
