"""Bindings of the driver's test tables to the vehicle-position data model.

The test data has no vehicle positions; every input here is derived by Spark
from a given table, so its size grows with that table:

* ``events`` → typed readings (``readings``) and raw daily-file lines (``raw_lines``),
* ``supplier`` → transit stops, ``orders`` → trips.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import RAW_HEADER


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _lat_text(k: Column) -> Column:
    # '37.' followed by 700 + k % 137  →  37.700 … 37.836
    return F.concat(F.lit("37."), (F.lit(700) + k % 137).cast("string"))


def _lon_text(k: Column) -> Column:
    # '-122.' followed by 540 - k % 173  →  -122.540 … -122.368
    return F.concat(F.lit("-122."), (F.lit(540) - k % 173).cast("string"))


def _speed(events: DataFrame) -> Column:
    return F.when(F.col("event_type").isin("view", "click"), F.lit(0.0)).otherwise(F.col("value"))


def _predictable(eid: Column) -> Column:
    return F.when(eid % 10 == 0, F.lit("0")).otherwise(F.lit("1"))


def readings_from_events(events: DataFrame) -> DataFrame:
    """Typed readings: one per event (see FIXTURES.md §3)."""
    eid = F.col("event_id")
    return events.select(
        eid.alias("reading_id"),
        F.lit("1").alias("rev"),
        F.col("ts").cast("timestamp_ntz").alias("report_time"),
        F.col("user_id").cast("string").alias("vehicle_tag"),
        _speed(events).alias("speed"),
        (eid % 360).cast("double").alias("heading"),
        F.col("event_type").alias("train_assignment"),
        _predictable(eid).alias("predictable"),
        _lat_text(eid).cast("double").alias("latitude"),
        _lon_text(eid).cast("double").alias("longitude"),
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed readings derived from ``events``."""
    return readings_from_events(table(spark, sf_dir, "events"))


def readings_hour_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings with report_time truncated to the hour: a table with duplicate (vehicle, time) keys."""
    r = readings(spark, sf_dir)
    return r.withColumn("report_time", F.date_trunc("hour", F.col("report_time")).cast("timestamp_ntz"))


def raw_lines_from_events(events: DataFrame) -> DataFrame:
    """Raw daily-file lines, one text column ``value``.

    Nine comma-separated fields (rev carries the event id), whole-second time
    text, empty speed for every 50th event, the file header glued in front of
    every 500th line, and one blank line after every even event.
    """
    eid = F.col("event_id")
    speed_text = F.when(eid % 50 == 0, F.lit("")).otherwise(F.format_string("%.2f", _speed(events)))
    line = F.concat_ws(
        ",",
        eid.cast("string"),
        F.date_format(F.col("ts"), "MM/dd/yyyy HH:mm:ss"),
        F.col("user_id").cast("string"),
        _lon_text(eid),
        _lat_text(eid),
        speed_text,
        (eid % 360).cast("string"),
        F.col("event_type"),
        _predictable(eid),
    )
    line = F.when(eid % 500 == 0, F.concat(F.lit(RAW_HEADER), line)).otherwise(line)
    lines = F.when(eid % 2 == 0, F.array(line, F.lit(""))).otherwise(F.array(line))
    return events.select(F.explode(lines).alias("value"))


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw daily-file lines derived from ``events``."""
    return raw_lines_from_events(table(spark, sf_dir, "events"))


def transit_stops_from_supplier(supplier: DataFrame) -> DataFrame:
    """Transit stops (stop_id = supplier key, coordinates by the reading rules)."""
    k = F.col("s_suppkey")
    null = F.lit(None).cast("string")
    return supplier.select(
        _lat_text(k).cast("double").alias("stop_lat"),
        k.cast("string").alias("stop_code"),
        _lon_text(k).cast("double").alias("stop_lon"),
        null.alias("stop_url"),
        k.cast("string").alias("stop_id"),
        null.alias("stop_desc"),
        F.col("s_name").alias("stop_name"),
        F.lit("0").alias("location_type"),
        F.col("s_nationkey").cast("string").alias("zone_id"),
    )


def transit_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transit stops derived from ``supplier``."""
    return transit_stops_from_supplier(table(spark, sf_dir, "supplier"))


def trips_from_orders(orders: DataFrame) -> DataFrame:
    """Trips (trip_id = order key, route_id = order priority)."""
    null = F.lit(None).cast("string")
    return orders.select(
        F.col("o_custkey").cast("string").alias("block_id"),
        F.col("o_orderpriority").alias("route_id"),
        null.alias("original_trip_id"),
        F.col("o_orderstatus").alias("direction_id"),
        null.alias("trip_headsign"),
        null.alias("shape_id"),
        null.alias("service_id"),
        F.col("o_orderkey").cast("string").alias("trip_id"),
    )


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips derived from ``orders``."""
    return trips_from_orders(table(spark, sf_dir, "orders"))


def readings_speed_shifted(spark: SparkSession, sf_dir: str, delta: float = 0.0001) -> DataFrame:
    """Comparison partner: the same readings with speed + delta."""
    r = readings(spark, sf_dir)
    return r.withColumn("speed", F.col("speed") + F.lit(delta))



def readings_scaled(spark: SparkSession, sf_dir: str, copies: int) -> DataFrame:
    """Readings of ``events`` repeated ``copies`` times as distinct vehicles (for scaling runs).

    Copy c shifts vehicle tags by c·10^7 and ids by c·10^10, so ids still follow
    time within every vehicle; rows are generated inside the tasks (``explode``).
    """
    r = readings(spark, sf_dir)
    c = F.explode(F.sequence(F.lit(0), F.lit(int(copies) - 1))).alias("_copy")
    rep = r.select("*", c)
    return rep.select(
        (F.col("reading_id") + F.col("_copy") * F.lit(10**10)).alias("reading_id"),
        "rev",
        "report_time",
        F.when(F.col("_copy") == 0, F.col("vehicle_tag"))
        .otherwise(F.concat(F.col("vehicle_tag"), F.lit("-"), F.col("_copy").cast("string")))
        .alias("vehicle_tag"),
        *[x for x in r.columns if x not in ("reading_id", "rev", "report_time", "vehicle_tag")],
    )
