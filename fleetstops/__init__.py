"""fleetstops: stop detection and reports over vehicle position histories, on Spark DataFrames.

The main entry points, all DataFrame → DataFrame::

    from fleetstops import ingest_avl, stopped_vehicles, list_stopped_vehicles, stops_detail

Importing needs no running Spark session; functions build plans when called.
"""

__version__ = "0.1.0"

from .operators.compare import approx_diff, content_diff, content_diff_by_digest, count_diff, diff_with, schema_diff
from .operators.near import inside_bounds, near, near_counts
from .operators.readings import dedupe_readings, ids_follow_time
from .operators.scan import history_scan
from .operators.stops import find_last_stopped, last_moving_time, next_speed, stop_ends_with_last_moving
from .plans.current import current_stops, list_stopped_vehicles, map_points
from .plans.daily import add_batch, stop_table
from .plans.fleet import stop_times, stopped_vehicles, stops_detail, stops_in_window
from .plans.history import heat_points, historical_stops
from .plans.ingestion import ingest_avl, ingest_files, ingest_files_with_log
from .plans.sql_functions import register_functions
from .plans.upsert import distinct_list, readings_table, refresh_values, upsert_batch
from .plans.vehicle import stopped_vehicle, vehicle_top_stops

__all__ = [
    "add_batch",
    "approx_diff",
    "content_diff",
    "content_diff_by_digest",
    "count_diff",
    "current_stops",
    "dedupe_readings",
    "diff_with",
    "distinct_list",
    "find_last_stopped",
    "heat_points",
    "historical_stops",
    "history_scan",
    "ids_follow_time",
    "ingest_avl",
    "ingest_files",
    "ingest_files_with_log",
    "inside_bounds",
    "last_moving_time",
    "list_stopped_vehicles",
    "map_points",
    "near",
    "near_counts",
    "next_speed",
    "readings_table",
    "refresh_values",
    "register_functions",
    "schema_diff",
    "stop_ends_with_last_moving",
    "stop_table",
    "stop_times",
    "stopped_vehicle",
    "stopped_vehicles",
    "stops_detail",
    "stops_in_window",
    "upsert_batch",
    "vehicle_top_stops",
]
