"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line:
{"metric": "total_query_seconds", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Each query is executed fully with the ``noop`` sink (no collect to the
driver); with BENCH_RUNS > 1 the median per query is reported.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "flow_counts", "anchored_windows", "fragments", "normalized_fragments", "flow_vectors", "dataset_split",
    "decay_1d", "jitter", "decay_2d", "host_stats", "detection_report", "robustness",
    "reference_distances", "proximity_ratio", "correlation_distance", "detector_score_fixed", "cnn_predict",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    from streamsift.plans.registry import REGISTRY, STORED
    from streamsift.session import get_spark

    spark = get_spark(app_name="streamsift-bench")
    # warm the JVM (class loading, code generation, Python workers) on the
    # smallest scale factor so that the first timed query is not charged for it
    warm = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm):
        for name in ("flow_counts", "decay_1d"):
            REGISTRY[name][0](spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for name in only or HEADLINE:
        fn = REGISTRY[name][0]
        if name in STORED:   # inference only: what it reads is stored before the clock starts
            prepare_, fn = STORED[name]
            stored = prepare_(spark, sf_dir)
            fn = (lambda f, x: lambda s, d: f(x))(fn, stored)
        samples = []
        for _ in range(runs):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            samples.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(samples), 3)
        print(f"{name}: {times[name]}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir,
                      "cpus": int(os.environ.get("BENCH_CPUS", "8")), "runs": runs}))
    spark.stop()


if __name__ == "__main__":
    main()
