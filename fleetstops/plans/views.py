"""SQL access: the result tables of the pipeline as temporary views.

The original workflow stored its results as database tables (stop times, the
stops of the fleet job, the detail table, distinct vehicle and assignment
lists) and asked questions of them in SQL. ``register_views`` registers the
same tables as Spark temporary views, so such SQL text runs unchanged through
``spark.sql`` (same optimizer as the DataFrame API).

The stop-derived views are computed once, when registered, and written as
Parquet tables in the shared checkpoint folder, so many SQL questions over them
do not recompute the stop detection and lineage stays short. The distinct lists
stay lazy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.readings import distinct_assignments, distinct_vehicles
from ..session import materialize
from .fleet import stop_times, stopped_vehicles, stops_detail

VIEWS = ("readings", "stop_times", "vehicle_stops", "stops_detail", "vehicles", "train_assignments")


def register_views(spark: SparkSession, readings: DataFrame, lower=None, upper=None, prefix: str = "") -> dict:
    """Register ``readings`` and the derived tables as temporary views; returns name → DataFrame.

    ``vehicle_stops`` holds the fleet job's long stops (report_time, vehicle_tag,
    stopped_for) between ``lower`` and ``upper`` (all when not given).
    """
    tables = {
        "readings": readings,
        "stop_times": materialize(stop_times(readings), "stop-times"),
        "vehicle_stops": materialize(stopped_vehicles(readings, lower, upper), "vehicle-stops"),
        "stops_detail": materialize(stops_detail(readings, lower, upper), "stops-detail"),
        "vehicles": distinct_vehicles(readings),
        "train_assignments": distinct_assignments(readings),
    }
    for name, df in tables.items():
        df.createOrReplaceTempView(prefix + name)
    return tables
