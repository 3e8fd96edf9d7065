"""Bounds and counts from Parquet footers against the same by reading rows."""

from pyspark.sql import functions as F

from fleetstops.operators.readings import coordinate_bounds, row_count, speed_bounds
from fleetstops.sources import bindings as B
from fleetstops.sources.footers import footer_aggregates, stored_bounds

from .conftest import SF_SMALL

COLUMNS = ["speed", "latitude", "longitude", "reading_id"]


def test_footers_equal_rows(spark, workdir):
    readings = B.readings(spark, SF_SMALL)
    readings.repartition(5).write.parquet(workdir + "/r")
    got = stored_bounds(spark, workdir + "/r", COLUMNS).first()
    assert (got.min_speed, got.max_speed) == tuple(speed_bounds(readings).first())
    assert (got.min_latitude, got.max_latitude, got.min_longitude, got.max_longitude) == tuple(coordinate_bounds(readings).first())
    assert got.row_count == row_count(readings).first()[0]
    plan = footer_aggregates(spark, workdir + "/r", COLUMNS)._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), MIN(speed), MAX(speed)" in plan
    # The caller's session reads as before.
    assert "PushedAggregation" not in spark.read.parquet(workdir + "/r").agg(F.max("speed"))._jdf.queryExecution().executedPlan().toString()


def test_missing_statistics_fall_back(spark, workdir):
    rows = [(1.0,), (float("nan"),), (-3.0,), (None,)]
    spark.createDataFrame(rows, "speed double").coalesce(1).write.parquet(workdir + "/r")
    got = stored_bounds(spark, workdir + "/r", ["speed"]).first()
    want = spark.read.parquet(workdir + "/r").agg(F.min("speed"), F.max("speed")).first()
    assert got.row_count == 4 and str((got.min_speed, got.max_speed)) == str(tuple(want))


def test_empty_and_null_columns(spark, workdir):
    spark.createDataFrame([], "speed double").write.parquet(workdir + "/none")
    assert tuple(stored_bounds(spark, workdir + "/none", ["speed"]).first()) == (0, None, None)
    spark.createDataFrame([(None,), (None,)], "speed double").write.parquet(workdir + "/nulls")
    assert tuple(stored_bounds(spark, workdir + "/nulls", ["speed"]).first()) == (2, None, None)
