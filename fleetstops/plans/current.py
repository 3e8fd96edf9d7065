"""Current stops: the look-back table function and its display forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import CURRENT_MAP_ROWS, CURRENT_TABLE_ROWS
from ..functions.time import display_time, empty_if_null, look_back_start, minutes_stopped, stop_length_rounded
from ..operators.reports import top_rows
from ..operators.stops import stop_ends_with_last_moving
from .checks import check_limit, check_look_back, check_query_time
from ..tuning import CHUNK_SECONDS


def list_stopped_vehicles(
    readings: DataFrame, query_time, look_back: int, *, chunk_seconds: int = CHUNK_SECONDS
) -> DataFrame:
    """Vehicles whose stop ended within ``look_back`` minutes before ``query_time``, longest first.

    Both the stop ends and the moving readings are taken from the look-back range
    only (the range is applied before ``lead``), so a stop that began before the
    range has no earlier moving reading and is left out.
    Columns: veh_tag, train_asng, stopped_at, stopped_for (int), lat, lon.
    """
    query_time, look_back = check_query_time(query_time), check_look_back(look_back)
    qt = F.lit(query_time).cast("timestamp_ntz")
    begin = look_back_start(query_time, look_back)
    r = readings.select(
        "reading_id", "vehicle_tag", "report_time", "speed", "train_assignment", "latitude", "longitude"
    ).filter(F.col("report_time").between(begin, qt))
    ends = stop_ends_with_last_moving(r, max_id_gap=None, chunk_seconds=chunk_seconds)
    dtype = r.schema["report_time"].dataType
    return ends.select(
        F.col("vehicle_tag").alias("veh_tag"),
        F.col("train_assignment").alias("train_asng"),
        F.col("report_time").alias("stopped_at"),
        stop_length_rounded("report_time", "last_moving_time", dtype).alias("stopped_for"),
        F.col("latitude").alias("lat"),
        F.col("longitude").alias("lon"),
    ).orderBy(F.col("stopped_for").desc(), "veh_tag", "stopped_at")


def _order():
    return [F.col("stopped_for").desc(), F.col("veh_tag"), F.col("stopped_at")]


def current_stops(
    readings: DataFrame,
    query_time,
    look_back: int,
    limit: int = CURRENT_TABLE_ROWS,
    *,
    chunk_seconds: int = CHUNK_SECONDS,
) -> DataFrame:
    """Display rows of :func:`list_stopped_vehicles`, first ``limit`` (0 = all).

    Columns: vehicle_tag, train_assignment ('' for none), stopped_at text,
    minutes (one decimal), latitude, longitude.
    """
    limit = check_limit(limit)
    s = list_stopped_vehicles(readings, query_time, look_back, chunk_seconds=chunk_seconds)
    top = top_rows(s, limit, _order())
    return top.select(
        F.col("veh_tag").alias("vehicle_tag"),
        empty_if_null("train_asng").alias("train_assignment"),
        display_time("stopped_at").alias("stopped_at"),
        minutes_stopped("stopped_for").alias("minutes"),
        F.col("lat").alias("latitude"),
        F.col("lon").alias("longitude"),
    )


def map_points(
    readings: DataFrame,
    query_time,
    look_back: int,
    limit: int = CURRENT_MAP_ROWS,
    *,
    chunk_seconds: int = CHUNK_SECONDS,
) -> DataFrame:
    """Map markers of the longest current stops: tag, lat, lng, minutes."""
    limit = check_limit(limit)
    s = list_stopped_vehicles(readings, query_time, look_back, chunk_seconds=chunk_seconds)
    top = top_rows(s, limit, _order())
    return top.select(
        F.col("veh_tag").alias("tag"),
        F.col("lat"),
        F.col("lon").alias("lng"),
        minutes_stopped("stopped_for").alias("minutes"),
    )
