"""Benchmark of the headline questions.

Runs each query at $BENCH_SF_DIR (default /root/testdata/sf0.1) on
local[$BENCH_CPUS] and prints one JSON line. Every query is executed to the
end with the ``noop`` sink (all rows produced, nothing collected); the time
per query is the best of $BENCH_RUNS runs after three warm-up runs of the flagship.
``stopped_vehicles_x10`` runs the flagship over ten copies of the readings
(distinct vehicles, generated inside the tasks) to show how the time grows.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "stopped_vehicles",
    "ingest_avl",
    "stop_times",
    "stops_detail",
    "list_stopped_vehicles",
    "hourly_stop_stats",
    "last_moving_time",
    "next_speed",
    "dedupe_readings",
    "content_diff",
    "ingest_then_stops",
    "last_moving_window",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    from fleetstops.plans.fleet import stopped_vehicles
    from fleetstops.registry import QUERIES
    from fleetstops.sources.bindings import readings_scaled
    from fleetstops.session import build_session

    spark = build_session(f"local[{cpus}]", cpus, app="fleetstops-bench")

    extra = {"stopped_vehicles_x10": lambda sp, sf: stopped_vehicles(readings_scaled(sp, sf, 10))}

    def run(name: str) -> float:
        t0 = time.perf_counter()
        fn = QUERIES.get(name) or extra[name]
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    for _ in range(3):
        run(HEADLINE[0])  # warm-up: JIT, file listing cache
    times = {}
    for name in HEADLINE + list(extra):
        times[name] = round(min(run(name) for _ in range(runs)), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(m.group(1)) if m else sf_dir,
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
