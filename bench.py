"""Runs the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON."""

from __future__ import annotations

import json
import os
import time

from tidewatch.plans.registry import QUERIES
from tidewatch.session import local_session

HEADLINE = (
    "gate_counts", "to_canonical", "dedup_mean", "sensor_select", "normalize_series", "median_interval", "sample_grid", "resample_interpolate", "gap_report", "hold_forward", "assign_state",
    "align_timeline", "tumbling_stats", "window_slope", "window_smooth_mid", "centered_smooth", "stage_fraction", "coarse_states", "movement_intensity", "state_runs", "stage_events", "merge_events",
    "topk_pinned", "build_stage_segments", "merge_intervals", "interval_ownership", "dedup_components", "auto_select", "weighted_combine", "rate_limit", "preset_spans", "fingerprint",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores=cpus, shuffle_partitions=cpus, driver_memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["attach_telemetry"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # the first query pays for compiling
    took = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
