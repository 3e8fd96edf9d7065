"""Historical stops by hour of day and length, for the table and the heat map."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import HISTORY_HEAT_ROWS, HISTORY_TABLE_ROWS
from ..functions.time import minutes_stopped, minutes_to_seconds
from ..operators.reports import stops_at_hour, top_rows
from .checks import check_hour, check_limit, check_stop_bound

def _checked(hour, min_minutes, max_minutes, limit):
    return (
        check_hour(hour),
        check_stop_bound(min_minutes, "minimum stop length"),
        check_stop_bound(max_minutes, "maximum stop length"),
        check_limit(limit),
    )


def _order():
    return [F.col("stopped_for").desc(), F.col("vehicle_tag"), F.col("report_time")]


def historical_stops(
    detail: DataFrame, hour: int, min_minutes: int = 0, max_minutes: int = 0, limit: int = HISTORY_TABLE_ROWS
) -> DataFrame:
    """Stops of the detail table at one hour with length bounds given in minutes (0 = no bound).

    Rows are put in a total order (longest first) before the limit, so the same
    rows come back every time.
    """
    hour, min_minutes, max_minutes, limit = _checked(hour, min_minutes, max_minutes, limit)
    s = stops_at_hour(detail, hour, minutes_to_seconds(min_minutes), minutes_to_seconds(max_minutes))
    top = top_rows(s, limit, _order())
    return top.select(
        "vehicle_tag",
        "report_time",
        "stopped_for",
        minutes_stopped("stopped_for").alias("minutes"),
        "hour_of_day",
        "latitude",
        "longitude",
    )


def heat_points(
    detail: DataFrame, hour: int, min_minutes: int = 0, max_minutes: int = 0, limit: int = HISTORY_HEAT_ROWS
) -> DataFrame:
    """Heat-map points (lat, lng) of historical stops."""
    hour, min_minutes, max_minutes, limit = _checked(hour, min_minutes, max_minutes, limit)
    s = stops_at_hour(detail, hour, minutes_to_seconds(min_minutes), minutes_to_seconds(max_minutes))
    top = top_rows(s, limit, _order())
    return top.select(F.col("latitude").alias("lat"), F.col("longitude").alias("lng"))
