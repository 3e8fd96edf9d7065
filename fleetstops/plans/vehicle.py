"""Single-vehicle stop questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.time import stop_length_rounded, stop_length_trunc
from ..operators.readings import for_vehicle
from ..operators.stops import stop_ends_with_last_moving
from ..tuning import CHUNK_SECONDS


def stopped_vehicle(readings: DataFrame, tag: str, *, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """Z3: one vehicle's stop ends with location, assignment, last moving time and length.

    The vehicle filter reaches the scan; the scan is still split by time chunk,
    so one vehicle's long history is not sorted in a single task.
    """
    r = for_vehicle(
        readings.select(
            "reading_id", "report_time", "vehicle_tag", "speed", "train_assignment", "latitude", "longitude"
        ),
        tag,
    )
    ends = stop_ends_with_last_moving(r, max_id_gap=None, chunk_seconds=chunk_seconds)
    dtype = r.schema["report_time"].dataType
    return ends.select(
        "reading_id",
        "report_time",
        "vehicle_tag",
        "speed",
        "train_assignment",
        "latitude",
        "longitude",
        "last_moving_time",
        stop_length_trunc("report_time", "last_moving_time", dtype).alias("stopped_for"),
    )


def vehicle_top_stops(readings: DataFrame, tag: str, *, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """One vehicle's stops with coordinates, longest first (length T3)."""
    r = for_vehicle(readings.select("reading_id", "report_time", "vehicle_tag", "speed", "latitude", "longitude"), tag)
    ends = stop_ends_with_last_moving(r, max_id_gap=None, chunk_seconds=chunk_seconds)
    dtype = r.schema["report_time"].dataType
    return ends.select(
        "report_time",
        "latitude",
        "longitude",
        stop_length_rounded("report_time", "last_moving_time", dtype).alias("stopped_for"),
    ).orderBy(F.col("stopped_for").desc(), "report_time")
