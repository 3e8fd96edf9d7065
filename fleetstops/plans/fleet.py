"""Fleet-wide stop questions: long stops (the flagship), the stop-times helper table,
the denormalised detail table and stops inside a time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import LONG_STOP_MAX_S, LONG_STOP_MIN_S, MAX_ID_GAP
from ..functions.time import hour_of_day, stop_length_rounded, stop_length_seconds
from ..operators.readings import between_times
from ..operators.stops import long_stops, stop_ends_with_last_moving
from ..tuning import CHUNK_SECONDS

_SCAN_COLS = ["reading_id", "vehicle_tag", "report_time", "speed"]


def stopped_vehicles(
    readings: DataFrame,
    lower=None,
    upper=None,
    *,
    max_id_gap: int | None = MAX_ID_GAP,
    min_s: int = LONG_STOP_MIN_S,
    max_s: int = LONG_STOP_MAX_S,
    chunk_seconds: int = CHUNK_SECONDS,
) -> DataFrame:
    """Which vehicles stood still for more than 5 minutes and less than 2 hours, when, how long.

    Readings are cut to [lower, upper] *before* the scan (the filter reaches the
    Parquet reader); a stop end needs a later moving reading and an earlier one
    inside the range. Output: report_time, vehicle_tag, stopped_for (long s).
    """
    r = readings.select(*_SCAN_COLS)
    if lower is not None or upper is not None:
        r = between_times(r, lower, upper)
    ends = stop_ends_with_last_moving(r, max_id_gap=max_id_gap, max_s=max_s, chunk_seconds=chunk_seconds)
    if max_id_gap is None:
        # One row per (vehicle, time), latest moving time, as the grouped join defines it.
        ends = ends.groupBy("vehicle_tag", "report_time").agg(F.max("last_moving_time").alias("last_moving_time"))
    return long_stops(
        ends.withColumn("stopped_for", stop_length_seconds("report_time", "last_moving_time")), min_s, max_s
    )


def stops_detail(
    readings: DataFrame,
    lower=None,
    upper=None,
    *,
    max_id_gap: int | None = MAX_ID_GAP,
    min_s: int = LONG_STOP_MIN_S,
    max_s: int = LONG_STOP_MAX_S,
    chunk_seconds: int = CHUNK_SECONDS,
) -> DataFrame:
    """Long stops with hour of day and the stop-end reading's coordinates.

    The stop end *is* a reading, so its coordinates ride along through the scan;
    no join back to the readings is needed.
    """
    r = readings.select(*_SCAN_COLS, "latitude", "longitude")
    if lower is not None or upper is not None:
        r = between_times(r, lower, upper)
    ends = stop_ends_with_last_moving(r, max_id_gap=max_id_gap, max_s=max_s, chunk_seconds=chunk_seconds)
    s = ends.withColumn("stopped_for", stop_length_seconds("report_time", "last_moving_time"))
    s = s.filter((F.col("stopped_for") > F.lit(int(min_s))) & (F.col("stopped_for") < F.lit(int(max_s))))
    return s.select(
        "report_time",
        "vehicle_tag",
        "stopped_for",
        hour_of_day("report_time").alias("hour_of_day"),
        "latitude",
        "longitude",
    )


def stop_times(
    readings: DataFrame, *, with_location: bool = False, chunk_seconds: int = CHUNK_SECONDS
) -> DataFrame:
    """Every stop end of every vehicle with the last moving time before it (no id bound).

    Columns vehicle_tag, stopped_at, stopped_since, stopped_for (int, T3); with
    ``with_location`` also latitude and longitude of the stop end.
    """
    extra = ["latitude", "longitude"] if with_location else []
    r = readings.select(*_SCAN_COLS, *extra)
    ends = stop_ends_with_last_moving(r, max_id_gap=None, chunk_seconds=chunk_seconds)
    dtype = r.schema["report_time"].dataType
    return ends.select(
        "vehicle_tag",
        F.col("report_time").alias("stopped_at"),
        F.col("last_moving_time").alias("stopped_since"),
        stop_length_rounded("report_time", "last_moving_time", dtype).alias("stopped_for"),
        *extra,
    )


def stops_in_window(readings: DataFrame, lower, upper, *, chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """Stop times that ended between two times, with coordinates, longest first.

    The time filter applies to finished stops (their last moving time may lie
    before ``lower``), so the scan runs over the whole history.
    """
    st = stop_times(readings, with_location=True, chunk_seconds=chunk_seconds)
    st = between_times(st, lower, upper, time="stopped_at")
    return st.select("vehicle_tag", "stopped_at", "stopped_for", "latitude", "longitude").orderBy(
        F.col("stopped_for").desc(), "vehicle_tag", "stopped_at"
    )


def stops_in_window_from_table(stop_times_table: DataFrame, readings: DataFrame, lower, upper) -> DataFrame:
    """Z5 over a stored stop-times table (as written by the ``stop-times`` job) joined to the readings.

    The time range is applied to both sides before the join (the stop end *is*
    the reading at ``stopped_at``), so each side's filter reaches its own scan and
    only the window's rows meet in the join.
    """
    from ..operators.reports import attach_location

    st = between_times(stop_times_table, lower, upper, time="stopped_at")
    r = between_times(readings.select("vehicle_tag", "report_time", "latitude", "longitude"), lower, upper)
    joined = attach_location(st, r, stop_keys=("vehicle_tag", "stopped_at"))
    return joined.select("vehicle_tag", "stopped_at", "stopped_for", "latitude", "longitude").orderBy(
        F.col("stopped_for").desc(), "vehicle_tag", "stopped_at"
    )
