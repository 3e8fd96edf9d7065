"""Grid-cell distance join and bounds against pair by pair, over the poles, the 180th meridian and odd positions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fleetstops.operators import near as N

ROWS = "id long, latitude double, longitude double, extra string"
PLACES = "stop_id string, stop_lat double, stop_lon double"


def metres(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * N.EARTH_M * math.asin(math.sqrt(min(h, 1)))


def good(p):
    return None not in p and not any(map(math.isnan, p)) and abs(p[0]) <= 90


def check(spark, points, places, radius):
    rows = spark.createDataFrame([(k, *p, "x") for k, p in enumerate(points)], ROWS).repartition(3)
    stops = spark.createDataFrame([(str(k), *p) for k, p in enumerate(places)], PLACES)
    pairs = {k: [d for q in places if good(p) and good(q) and (d := metres(p, q)) <= radius] for k, p in enumerate(points)}
    want = {k for k, d in pairs.items() if d}
    got = N.near(rows, stops, radius)
    assert got.columns == rows.columns and sorted(r.id for r in got.collect()) == sorted(want)
    assert sorted(r.id for r in N.near(rows, stops, radius, away=True).collect()) == sorted(set(pairs) - want)
    counts = {r.id: (r.places, r.nearest) for r in N.near_counts(rows, stops, radius, ["id"]).collect()}
    assert {k: v[0] for k, v in counts.items()} == {k: len(pairs[k]) for k in want}
    assert all(v[1] == pytest.approx(min(pairs[k]), abs=1e-6) for k, v in counts.items())
    return want


@pytest.mark.parametrize("centre", [(37.77, -122.42), (0.0, 0.0), (-60.0, 179.9995), (70.0, -180.0), (88.9, 10.0), (89.99, 0.0), (-89.9999, 120.0)])
@pytest.mark.parametrize("radius", [30.0, 2500.0])
def test_against_pairs(spark, centre, radius):
    rng = random.Random(int(radius) + int(centre[0]))
    wide = math.degrees(radius / N.EARTH_M) * 3

    def some(n):
        out = []
        for _ in range(n):
            lat = max(-90.0, min(90.0, centre[0] + rng.uniform(-wide, wide)))
            lon = centre[1] + rng.uniform(-wide, wide) / max(math.cos(math.radians(lat)), 1e-4)
            out.append((lat, (lon + 180) % 360 - 180))
        return out

    assert check(spark, some(120), some(25), radius)


def test_odd_positions_and_empty_tables(spark):
    nan = float("nan")
    points = [(None, 1.0), (1.0, None), (nan, 1.0), (91.0, 0.0), (1.0, 1.0), (1.0, 1.0), (90.0, 5.0), (-90.0, 0.0)]
    check(spark, points, [(1.0, 1.0), (1.0, 1.0), (None, None), (nan, nan), (95.0, 0.0), (90.0, -170.0)], 100.0)
    check(spark, points, [], 100.0)
    check(spark, [], [(1.0, 1.0)], 100.0)


def test_cells_can_be_split_and_no_pairs_of_all_are_made(spark):
    rows = spark.createDataFrame([(1, 1.0, 1.0, "x")], ROWS)
    stops = spark.createDataFrame([("a", 1.0, 1.0)], PLACES)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = N.near(rows, stops, 50.0, away=True)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin [_fs_cell" in plan and "LeftAnti" in plan and "NestedLoop" not in plan


def test_bounds(spark):
    rows = spark.createDataFrame([(1, 1.0, 1.0, "in"), (2, 0.0, 0.0, "edge"), (3, 2.5, 1.0, "out"), (4, None, 1.0, "none"), (5, 1.0, -0.1, "out")], ROWS)
    stops = spark.createDataFrame([("a", 0.0, 0.0), ("b", 2.0, 3.0), ("c", None, None)], PLACES)
    assert sorted(r.id for r in N.inside_bounds(rows, stops).collect()) == [1, 2]
    assert sorted(r.id for r in N.inside_bounds(rows, stops, outside=True).collect()) == [3, 4, 5]
    empty = stops.filter("stop_id = 'z'")
    assert N.inside_bounds(rows, empty).count() == 0 and N.inside_bounds(rows, empty, outside=True).count() == 5


def test_bounds_reach_the_scan(spark, workdir):
    spark.range(1000).select("id", (F.col("id") / 100).alias("latitude"), F.lit(1.0).alias("longitude")).write.parquet(workdir + "/r")
    stops = spark.createDataFrame([("a", 3.0, 0.0), ("b", 4.0, 3.0)], PLACES)
    got = N.inside_bounds(spark.read.parquet(workdir + "/r"), stops)
    assert got.count() == 101
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "scalar-subquery" in plan.split("FileScan")[1].split("\n")[0].lower() or "Subquery" in plan
