"""Schemas of the tables the engine reads and writes."""

from pyspark.sql import types as T

from .constants import TRANSIT_STOP_DOUBLE_FIELDS, TRANSIT_STOP_FIELDS, TRIP_FIELDS

# Typed readings.
READINGS = T.StructType(
    [
        T.StructField("reading_id", T.LongType(), False),
        T.StructField("rev", T.StringType()),
        T.StructField("report_time", T.TimestampNTZType()),
        T.StructField("vehicle_tag", T.StringType()),
        T.StructField("speed", T.DoubleType()),
        T.StructField("heading", T.DoubleType()),
        T.StructField("train_assignment", T.StringType()),
        T.StructField("predictable", T.StringType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
    ]
)

TRANSIT_STOPS = T.StructType(
    [
        T.StructField(c, T.DoubleType() if c in TRANSIT_STOP_DOUBLE_FIELDS else T.StringType())
        for c in TRANSIT_STOP_FIELDS
    ]
)

TRIPS = T.StructType([T.StructField(c, T.StringType()) for c in TRIP_FIELDS])

STOP_TIMES = T.StructType(
    [
        T.StructField("vehicle_tag", T.StringType()),
        T.StructField("stopped_at", T.TimestampNTZType()),
        T.StructField("stopped_since", T.TimestampNTZType()),
        T.StructField("stopped_for", T.IntegerType()),
    ]
)

