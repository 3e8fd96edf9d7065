"""Joins and reports on detected stops: locations, hourly statistics, hour filters, top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import AFTERNOON_HOUR, AFTERNOON_MIN_S
from ..functions.time import hour_of_day


def attach_by_time(stop_ends: DataFrame, last_moving_info: DataFrame, time: str = "report_time") -> DataFrame:
    """Equi-join of stop ends to last-moving information on the report time.

    Both sides are hash-partitioned on the time, so no value of the time key
    can gather more than its own duplicates.
    """
    info = last_moving_info.drop(*[c for c in last_moving_info.columns if c in stop_ends.columns and c != time])
    return stop_ends.join(info, on=time, how="inner")


def attach_location(
    stops: DataFrame,
    readings: DataFrame,
    *,
    stop_keys=("vehicle_tag", "report_time"),
    reading_keys=("vehicle_tag", "report_time"),
    columns=("latitude", "longitude"),
) -> DataFrame:
    """Fetch reading columns for stored stops by (vehicle, time).

    A plain equi-join: AQE turns it into a broadcast join at run time when the
    measured stop side is small, and otherwise shuffles both sides on the key.
    """
    r = readings.select(
        *[F.col(rk).alias(sk) for rk, sk in zip(reading_keys, stop_keys)], *[F.col(c) for c in columns]
    )
    return stops.join(r, on=list(stop_keys), how="inner")


def with_hour_of_day(stops: DataFrame, time: str = "report_time") -> DataFrame:
    """Add ``hour_of_day``."""
    return stops.withColumn("hour_of_day", hour_of_day(time))


def hourly_stop_stats(stops: DataFrame, time: str = "report_time") -> DataFrame:
    """A5: number of stops and average stop length per hour of day, in hour order."""
    return (
        stops.groupBy(hour_of_day(time).alias("hour_of_day"))
        .agg(F.count(F.lit(1)).alias("stops"), F.avg("stopped_for").alias("avg_stopped_for"))
        .orderBy("hour_of_day")
    )


def stops_at_hour(detail: DataFrame, hour: int, min_s: int = 0, max_s: int = 0) -> DataFrame:
    """stops at one hour of day; bounds are inclusive and 0 or less means no bound."""
    out = detail.filter(F.col("hour_of_day") == F.lit(int(hour)))
    if min_s > 0:
        out = out.filter(F.col("stopped_for") >= F.lit(int(min_s)))
    if max_s > 0:
        out = out.filter(F.col("stopped_for") <= F.lit(int(max_s)))
    return out


def long_stops_at_hour(detail: DataFrame, hour: int = AFTERNOON_HOUR, min_s: int = AFTERNOON_MIN_S) -> DataFrame:
    """F8: stops at one hour longer than ``min_s`` seconds."""
    return detail.filter((F.col("hour_of_day") == F.lit(int(hour))) & (F.col("stopped_for") > F.lit(int(min_s)))).select(
        "vehicle_tag", "report_time", "stopped_for", "latitude", "longitude"
    )


def list_vehicles(readings: DataFrame, key: str = "vehicle_tag") -> DataFrame:
    """O2: all vehicles, ordered by tag."""
    return readings.select(key).distinct().orderBy(key)


def top_rows(df: DataFrame, k: int, order: list[Column]) -> DataFrame:
    """The first ``k`` rows in a total order (``k`` = 0: all rows, sorted).

    ``orderBy().limit(k)`` plans as TakeOrderedAndProject: each partition keeps
    its own top k, and only those reach the final merge.
    """
    out = df.orderBy(*order)
    return out.limit(int(k)) if k and k > 0 else out
