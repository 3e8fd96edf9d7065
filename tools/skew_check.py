"""Skew experiment: one vehicle holding a large share of all readings.

Builds readings from ``events`` repeated ``copies`` times; the first ``hot``
copies all belong to one vehicle (times shifted by the copy number in
microseconds so keys stay unique). Then runs the fleet question split by day, as by default, and
in pieces of a century (every vehicle one piece), checks both give the same rows, and
prints the timings as one JSON line.

    python tools/skew_check.py [sf_dir] [copies] [hot]
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

WHOLE = 100 * 365 * 86_400


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    copies = int(sys.argv[2]) if len(sys.argv) > 2 else 60
    hot = int(sys.argv[3]) if len(sys.argv) > 3 else 24
    from pyspark.sql import functions as F

    from fleetstops.plans.fleet import stopped_vehicles
    from fleetstops.session import build_session, materialize
    from fleetstops.sources.bindings import readings

    spark = build_session("local[8]", 8, app="fleetstops-skew")
    r = readings(spark, sf_dir)
    c = F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("c")
    x = r.select("*", c)
    is_hot = F.col("c") < hot
    data = materialize(
        x.select(
            (F.col("reading_id") * copies + F.col("c")).alias("reading_id"),
            F.when(is_hot, F.timestamp_add("MICROSECOND", F.col("c"), F.col("report_time")))
            .otherwise(F.col("report_time"))
            .alias("report_time"),
            F.when(is_hot, F.lit("HOT"))
            .otherwise(F.concat(F.col("vehicle_tag"), F.lit("-"), F.col("c").cast("string")))
            .alias("vehicle_tag"),
            "speed",
        ),
        "skew-readings",
    )

    def timed(f):
        t0 = time.perf_counter()
        rows = f().collect()
        return time.perf_counter() - t0, rows

    # Alternate the two lengths and keep the best of two runs each (the first run also warms the JVM).
    runs = {"day": [], "whole": []}
    for _ in range(2):
        t, a = timed(lambda: stopped_vehicles(data))
        runs["day"].append(t)
        t, b = timed(lambda: stopped_vehicles(data, chunk_seconds=WHOLE))
        runs["whole"].append(t)
    largest = data.groupBy("vehicle_tag", F.to_date("report_time")).count().agg(F.max("count")).first()[0]
    print(
        json.dumps(
            {
                "rows": data.count(),
                "hot_rows": data.filter("vehicle_tag = 'HOT'").count(),
                "largest_piece": largest,
                "day_s": round(min(runs["day"]), 3),
                "whole_s": round(min(runs["whole"]), 3),
                "same_result": sorted(a) == sorted(b),
                "stops": len(a),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
