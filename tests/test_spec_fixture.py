"""The original pipeline's unit spec: eight readings of two vehicles and five golden stages.

Comparison here is order-insensitive (the golden rows are compared as sets with
their schema), each stage fed with the golden output of the stage before.
"""

import datetime as dt

from pyspark.sql import Row
from pyspark.sql import types as T

from fleetstops.operators import stops as ST


def ts(s):
    return dt.datetime.strptime(f"2013-01-10 {s}", "%Y-%m-%d %H:%M:%S")


# The original spec's eight readings, and below the rows that it expects of each stage.
READINGS = [
    (1, "B456", ts("11:10:20"), 5),
    (2, "B456", ts("11:16:00"), 0),
    (3, "B456", ts("11:16:20"), 0),
    (4, "B456", ts("11:16:50"), 12),
    (5, "C789", ts("11:15:20"), 7),
    (6, "C789", ts("11:16:00"), 10),
    (7, "C789", ts("11:16:20"), 0),
    (8, "C789", ts("11:16:50"), 9),
]
READ_SCHEMA = T.StructType(
    [
        T.StructField("reading_id", T.IntegerType(), False),
        T.StructField("vehicle_tag", T.StringType()),
        T.StructField("report_time", T.TimestampType()),
        T.StructField("speed", T.IntegerType(), False),
    ]
)
STOPPED = [(3, "B456", ts("11:16:20"), 0, 12), (7, "C789", ts("11:16:20"), 0, 9)]
STOPPED_SCHEMA = T.StructType(list(READ_SCHEMA.fields) + [T.StructField("next_speed", T.IntegerType())])
MOVING = [r for r in READINGS if r[0] in (1, 4, 5, 6, 8)]
LAST_MOVING = [("B456", ts("11:16:20"), ts("11:10:20")), ("C789", ts("11:16:20"), ts("11:16:00"))]
LAST_MOVING_SCHEMA = T.StructType(
    [
        T.StructField("vehicle_tag", T.StringType()),
        T.StructField("report_time", T.TimestampType()),
        T.StructField("last_moving_time", T.TimestampType()),
    ]
)
STOP_LENGTH = [r + (n,) for r, n in zip(LAST_MOVING, (360, 20))]
STOP_LENGTH_SCHEMA = T.StructType(list(LAST_MOVING_SCHEMA.fields) + [T.StructField("stopped_for", T.LongType())])


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_stop_ends_of_the_fixture(spark):
    df = spark.createDataFrame(READINGS, READ_SCHEMA)
    out = ST.find_last_stopped(df, chunk_seconds=60)
    assert [f.name for f in out.schema.fields] == [f.name for f in STOPPED_SCHEMA.fields]
    assert [f.dataType for f in out.schema.fields] == [f.dataType for f in STOPPED_SCHEMA.fields]
    assert rows(out) == sorted(STOPPED)


def test_moving_readings_of_the_fixture(spark):
    df = spark.createDataFrame(READINGS, READ_SCHEMA)
    out = ST.filter_moving(df)
    assert out.schema == READ_SCHEMA
    assert rows(out) == sorted(MOVING)


def test_last_moving_times_of_the_fixture(spark):
    stopped = spark.createDataFrame(STOPPED, STOPPED_SCHEMA)
    moving = spark.createDataFrame(MOVING, READ_SCHEMA)
    out = ST.last_moving_time(stopped, moving, chunk_seconds=60)
    assert [(f.name, f.dataType) for f in out.schema.fields] == [(f.name, f.dataType) for f in LAST_MOVING_SCHEMA]
    assert rows(out) == sorted(LAST_MOVING)


def test_stop_lengths_of_the_fixture(spark):
    lm = spark.createDataFrame(LAST_MOVING, LAST_MOVING_SCHEMA)
    out = ST.calculate_stop_length(lm)
    assert [(f.name, f.dataType) for f in out.schema.fields] == [(f.name, f.dataType) for f in STOP_LENGTH_SCHEMA]
    assert rows(out) == sorted(STOP_LENGTH)


def test_long_stops_of_the_fixture(spark):
    sl = spark.createDataFrame(STOP_LENGTH, STOP_LENGTH_SCHEMA)
    out = ST.long_stops(sl)
    assert out.columns == ["report_time", "vehicle_tag", "stopped_for"]
    assert rows(out) == [(ts("11:16:20"), "B456", 360)]


def test_one_pass_flagship_on_the_fixture(spark):
    """Stages fused into one scan give the same final row."""
    from fleetstops.plans.fleet import stopped_vehicles

    df = spark.createDataFrame(READINGS, READ_SCHEMA)
    for chunk in (1, 60, 3600):
        out = stopped_vehicles(df, chunk_seconds=chunk)
        assert rows(out) == [(ts("11:16:20"), "B456", 360)], chunk


def test_stop_length_variants_agree_on_whole_seconds(spark):
    from pyspark.sql import functions as F

    from fleetstops.functions import time as TM

    lm = spark.createDataFrame(LAST_MOVING, LAST_MOVING_SCHEMA)
    dtype = lm.schema["report_time"].dataType
    out = lm.select(
        TM.stop_length_seconds("report_time", "last_moving_time").alias("t1"),
        TM.stop_length_trunc("report_time", "last_moving_time", dtype).alias("t2"),
        TM.stop_length_rounded("report_time", "last_moving_time", dtype).alias("t3"),
    )
    assert sorted(tuple(r) for r in out.collect()) == [(20, 20, 20), (360, 360, 360)]
    # Sub-second input: 1.9 s → 3.1 s gives 2 (clock seconds), 1 (truncated), 1 (rounded 1.2).
    sub = spark.createDataFrame([Row(a=dt.datetime(2024, 1, 1, 0, 0, 3, 100000), b=dt.datetime(2024, 1, 1, 0, 0, 1, 900000))])
    sub = sub.select(F.col("a").cast("timestamp_ntz").alias("a"), F.col("b").cast("timestamp_ntz").alias("b"))
    r = sub.select(
        TM.stop_length_seconds("a", "b"), TM.stop_length_trunc("a", "b"), TM.stop_length_rounded("a", "b")
    ).first()
    assert tuple(r) == (2, 1, 1)


def test_flagship_one_row_per_vehicle_and_time_with_ties(spark):
    """Two stop ends at one (vehicle, time) (data not deduplicated) give one row, as the grouped join does."""
    from fleetstops.plans.fleet import stopped_vehicles

    rows = [
        (1, "T1", ts("10:00:00"), 5),
        (2, "T1", ts("10:10:00"), 0),
        (3, "T1", ts("10:10:00"), 4),
        (4, "T1", ts("10:10:00"), 0),
        (5, "T1", ts("10:20:00"), 9),
    ]
    df = spark.createDataFrame(rows, READ_SCHEMA)
    out = stopped_vehicles(df).collect()
    assert len({(r.vehicle_tag, r.report_time) for r in out}) == len(out)
