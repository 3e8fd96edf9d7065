"""Named queries over tables that are kept batch by batch: the whole input goes through in several batches.

Each makes new tables in the shared folder, so building one of these queries runs its batches.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators.readings import between_times
from .plans import daily, upsert
from .session import shared_path
from .sources import bindings as B
from .sources.footers import stored_bounds

#: Where the readings are cut into batches (the first and the last one are open).
CUTS = ("2024-01-08 00:00:00", "2024-01-16 00:00:00", "2024-01-24 00:00:00")
#: Readings by the remainder of their id, in this order of batches; the first one comes twice.
TURNS = (1, 0, 2, 1)
WATCHED = ("vehicle_tag", "train_assignment", "heading")


def _stop_tables(spark, sf) -> str:
    """The folder of the stop tables after all batches of the readings."""
    root, after = shared_path(spark, "stop-tables"), None
    readings = B.readings(spark, sf)
    for lower, upper in zip((None, *CUTS), (*CUTS, None), strict=True):
        part = between_times(readings, lower, upper)
        if upper is not None:
            part = part.filter(F.col("report_time") < F.lit(upper).cast("timestamp_ntz"))
        name = "first" if lower is None else lower[:10]
        daily.add_batch(spark, part, root, name, after)
        after = name
    return root


def _upserted(spark, sf, watched=upsert.WATCHED, refresh: bool = False) -> str:
    """The folder of the readings table after all batches, which hold duplicate keys within and across them."""
    root = shared_path(spark, "readings-table")
    readings = B.readings_hour_keys(spark, sf)
    for turn in TURNS:
        part = readings.filter(F.col("reading_id") % 3 == turn)
        upsert.upsert_batch(spark, part, root, f"turn-{turn}", period="week", buckets=4, watched=watched)
        if refresh:
            upsert.refresh_values(spark, root)
    return root


def q_stop_times_by_batch(spark, sf):
    """Z4 kept batch by batch over a carry table."""
    return daily.stop_table(spark, _stop_tables(spark, sf), "stop_times")


def q_stops_detail_by_batch(spark, sf):
    """Z8 kept batch by batch over a carry table."""
    return daily.stop_table(spark, _stop_tables(spark, sf), "stops_detail")


def q_upsert_readings(spark, sf):
    """J6 and S8 over batches, one of them replayed."""
    return upsert.readings_table(spark, _upserted(spark, sf)).drop(upsert.BATCH)


def q_refresh_values(spark, sf):
    """S11 refreshed after each batch from its changes: values with their numbers of rows."""
    return upsert.refresh_values(spark, _upserted(spark, sf, WATCHED, refresh=True))


def q_stored_bounds(spark, sf):
    """A3, A4 and A7 over the readings stored as a table, from its footers."""
    path = shared_path(spark, "stored-readings")
    B.readings(spark, sf).write.parquet(path)
    return stored_bounds(spark, path, ["speed", "latitude", "longitude"])


QUERIES = {
    "stop_times_by_batch": q_stop_times_by_batch,
    "stops_detail_by_batch": q_stops_detail_by_batch,
    "upsert_readings": q_upsert_readings,
    "refresh_values": q_refresh_values,
    "stored_bounds": q_stored_bounds,
}
