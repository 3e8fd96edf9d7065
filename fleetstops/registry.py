"""Named queries over the driver's test tables: each takes (spark, sf_dir) and returns a DataFrame.

Every query reads whole tables (through :mod:`fleetstops.sources.bindings`).
Parameters (look-back time, hour, vehicle, windows) are the bindings of
FIXTURES.md §3; limits appear only where the limit is the feature (top-k pages).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .constants import CURRENT_MAP_ROWS, CURRENT_TABLE_ROWS, HISTORY_HEAT_ROWS, HISTORY_TABLE_ROWS, RAW_HEADER
from .functions import cleaning as C
from .functions import time as TM
from .operators import compare as CMP
from .operators import ingest as ING
from .operators import near as NR
from .operators import readings as RD
from .operators import reports as RP
from .operators import stops as ST
from .plans import current as CUR
from .plans import fleet as FL
from .plans import history as HI
from .plans import ingestion as IN
from .plans import sql_functions as SF
from .plans import vehicle as VH
from .registry_batches import QUERIES as BATCH_QUERIES
from .sources import bindings as B

# Bindings (FIXTURES.md §3).
DATA_LOWER = "2024-01-01 00:00:00"  # the whole month of events
DATA_UPPER = "2024-02-01 00:00:00"
RANGE_LOWER = "2024-01-10 00:00:00"
RANGE_UPPER = "2024-01-12 00:00:00"
QUERY_TIME = "2024-01-15 12:00:00"
QUERY_TIMES = ("2024-01-06 00:00:00", QUERY_TIME, "2024-01-25 18:30:00")
LOOK_BACK_MIN = 4320
HOUR = 16
HOUR_MIN_S, HOUR_MAX_S = 600, 3600
HIST_MIN_MIN, HIST_MAX_MIN = 5, 120
VEHICLE = "7"
WINDOW_LOWER = "2024-01-10 00:00:00"
WINDOW_UPPER = "2024-01-20 00:00:00"
TOP_K = 25
NEAR_M = 250.0  # a stop this near to a transit stop is taken as one at it
PAGE_ROWS = 6
APPROX_TOL = 0.00005

Query = Callable[[SparkSession, str], DataFrame]


def _r(spark, sf):
    return B.readings(spark, sf)


def _staging(spark, sf):
    return ING.clean_raw_lines(B.raw_lines(spark, sf))


def _detail(spark, sf):
    return FL.stops_detail(_r(spark, sf))


def _stop_lengths(spark, sf, fn, dtype_arg: bool):
    """J2 on stop ends with one of the three stop-length definitions."""
    r = _r(spark, sf).select("reading_id", "vehicle_tag", "report_time", "speed")
    ends = ST.stop_ends_with_last_moving(r, max_id_gap=None)
    length = fn("report_time", "last_moving_time", r.schema["report_time"].dataType) if dtype_arg else fn(
        "report_time", "last_moving_time"
    )
    return ends.select("vehicle_tag", "report_time", "last_moving_time", length.alias("stopped_for"))


# --- Z: composite questions -------------------------------------------------


def q_stopped_vehicles(spark, sf):
    return FL.stopped_vehicles(_r(spark, sf), DATA_LOWER, DATA_UPPER)


def q_ingest_avl(spark, sf):
    return IN.ingest_avl(B.raw_lines(spark, sf), reading_id_from="rev")


def q_stopped_vehicle(spark, sf):
    return VH.stopped_vehicle(_r(spark, sf), VEHICLE)


def q_stop_times(spark, sf):
    return FL.stop_times(_r(spark, sf))


def q_stops_in_window(spark, sf):
    return FL.stops_in_window(_r(spark, sf), WINDOW_LOWER, WINDOW_UPPER)


def q_list_stopped_vehicles(spark, sf):
    return CUR.list_stopped_vehicles(_r(spark, sf), QUERY_TIME, LOOK_BACK_MIN)


def q_current_stops(spark, sf):
    return CUR.current_stops(_r(spark, sf), QUERY_TIME, LOOK_BACK_MIN, CURRENT_TABLE_ROWS)


def q_stops_detail(spark, sf):
    return _detail(spark, sf)


def q_historical_stops(spark, sf):
    return HI.historical_stops(_detail(spark, sf), HOUR, HIST_MIN_MIN, HIST_MAX_MIN, HISTORY_TABLE_ROWS)


def q_map_points(spark, sf):
    return CUR.map_points(_r(spark, sf), QUERY_TIME, LOOK_BACK_MIN, CURRENT_MAP_ROWS)


def q_heat_points(spark, sf):
    return HI.heat_points(_detail(spark, sf), HOUR, HIST_MIN_MIN, HIST_MAX_MIN, HISTORY_HEAT_ROWS)


def q_vehicle_top_stops(spark, sf):
    return VH.vehicle_top_stops(_r(spark, sf), VEHICLE)


# --- P: cleaning ------------------------------------------------------------


def q_drop_blank_lines(spark, sf):
    return ING.drop_blank_lines(B.raw_lines(spark, sf))


def q_strip_header(spark, sf):
    return ING.strip_headers(ING.drop_blank_lines(B.raw_lines(spark, sf)))


def q_split_fields(spark, sf):
    return _staging(spark, sf)


def q_parse_report_time(spark, sf):
    return _staging(spark, sf).select("rev", C.parse_report_time("report_time").alias("report_time"))


def q_empty_to_null_double(spark, sf):
    s = _staging(spark, sf)
    return s.select(
        "rev",
        C.empty_to_null_double("speed").alias("speed"),
        C.empty_to_null_double("latitude").alias("latitude"),
        C.empty_to_null_double("longitude").alias("longitude"),
    )


def q_truncate_text(spark, sf):
    s = _staging(spark, sf)
    return s.select(
        "rev", C.truncate_text("vehicle_tag").alias("vehicle_tag"), C.truncate_text("train_assignment").alias("train_assignment")
    )


def q_promote_readings(spark, sf):
    return ING.promote_readings(_staging(spark, sf), reading_id_from="rev")


def q_make_point(spark, sf):
    s = _staging(spark, sf).select("rev", C.make_point("latitude", "longitude").alias("point"))
    return s.select("rev", F.col("point.lat").alias("lat"), F.col("point.lon").alias("lon"))


def q_substring_tail(spark, sf):
    raw = ING.drop_blank_lines(B.raw_lines(spark, sf))
    return raw.select(C.substring_tail("value", len(RAW_HEADER)).alias("value"))


def q_drop_last_char(spark, sf):
    return B.raw_lines(spark, sf).select(C.drop_last_char("value").alias("value"))


def q_dense_ids(spark, sf):
    """Ids in the order of time over typed readings that come without one."""
    return ING.promote_readings(_staging(spark, sf)).select("reading_id", "rev", "report_time", "vehicle_tag")


def q_ingest_then_stops(spark, sf):
    """Z1 then Z2: raw lines ingested without given ids, and the fleet's long stops among them."""
    return FL.stopped_vehicles(IN.ingest_avl(B.raw_lines(spark, sf)))


# --- F: filters ---------------------------------------------------------------


def q_filter_moving(spark, sf):
    return ST.filter_moving(_r(spark, sf).select("reading_id", "vehicle_tag", "report_time", "speed"))


def q_filter_stopped(spark, sf):
    return ST.filter_stopped(_r(spark, sf).select("reading_id", "vehicle_tag", "report_time", "speed"))


def q_find_last_stopped(spark, sf):
    return ST.find_last_stopped(_r(spark, sf).select("reading_id", "vehicle_tag", "report_time", "speed"))


def q_long_stops(spark, sf):
    return ST.long_stops(_stop_lengths(spark, sf, TM.stop_length_seconds, False))


def q_between_times(spark, sf):
    return RD.between_times(_r(spark, sf), RANGE_LOWER, RANGE_UPPER).select("reading_id", "vehicle_tag", "report_time")


def q_for_vehicle(spark, sf):
    return RD.for_vehicle(_r(spark, sf), VEHICLE)


def q_stops_at_hour(spark, sf):
    return RP.stops_at_hour(_detail(spark, sf), HOUR, HOUR_MIN_S, HOUR_MAX_S)


def q_long_stops_at_hour(spark, sf):
    return RP.long_stops_at_hour(_detail(spark, sf), HOUR, 600)


# --- J: joins (window forms) -------------------------------------------------------


def q_last_moving_time(spark, sf):
    r = _r(spark, sf).select("reading_id", "vehicle_tag", "report_time", "speed")
    return ST.last_moving_time(ST.find_last_stopped(r), ST.filter_moving(r))


def q_last_moving_time_unbounded(spark, sf):
    r = _r(spark, sf).select("reading_id", "vehicle_tag", "report_time", "speed")
    return ST.last_moving_time_unbounded(ST.filter_stopped(r), ST.filter_moving(r))


def q_last_moving_time_one_vehicle(spark, sf):
    v = RD.for_vehicle(_r(spark, sf).select("reading_id", "vehicle_tag", "report_time", "speed"), VEHICLE)
    ends = ST.stop_ends_with_last_moving(v, max_id_gap=None)
    return ends.select(
        F.col("report_time").alias("stopped_at"),
        F.col("last_moving_time").alias("stopped_since"),
        TM.stop_length_rounded("report_time", "last_moving_time").alias("stopped_for"),
    )


def q_attach_by_time(spark, sf):
    v = RD.for_vehicle(_r(spark, sf).select("reading_id", "vehicle_tag", "report_time", "speed"), VEHICLE)
    stop_ends = ST.find_last_stopped(v)
    info = ST.last_moving_time_unbounded(ST.filter_stopped(v), ST.filter_moving(v))
    info = info.withColumn("stopped_for", TM.stop_length_trunc("report_time", "last_moving_time"))
    return RP.attach_by_time(stop_ends, info).select("reading_id", "report_time", "last_moving_time", "stopped_for")


def q_attach_location(spark, sf):
    r = _r(spark, sf)
    stops = FL.stopped_vehicles(r)
    return RP.attach_location(stops, r)


def q_dedupe_readings(spark, sf):
    return RD.dedupe_readings(B.readings_hour_keys(spark, sf))


# --- A: aggregates ---------------------------------------------------------------


def q_duplicate_keys(spark, sf):
    return RD.duplicate_keys(B.readings_hour_keys(spark, sf))


def q_speed_bounds(spark, sf):
    return RD.speed_bounds(_r(spark, sf))


def q_coordinate_bounds(spark, sf):
    return RD.coordinate_bounds(_r(spark, sf))


def q_transit_stop_bounds(spark, sf):
    return RD.coordinate_bounds(B.transit_stops(spark, sf), lat="stop_lat", lon="stop_lon")


def q_transit_stops(spark, sf):
    return B.transit_stops(spark, sf).select("stop_id", "stop_name", "stop_lat", "stop_lon", "zone_id")


def q_trips(spark, sf):
    return B.trips(spark, sf).select("trip_id", "route_id", "block_id", "direction_id")


def q_hourly_stop_stats(spark, sf):
    return RP.hourly_stop_stats(FL.stopped_vehicles(_r(spark, sf)))


def q_distinct_vehicles(spark, sf):
    return RD.distinct_vehicles(_r(spark, sf))


def q_distinct_assignments(spark, sf):
    return RD.distinct_assignments(_r(spark, sf))


def q_ids_follow_time(spark, sf):
    return RD.ids_follow_time(B.readings_hour_keys(spark, sf))


def q_row_count(spark, sf):
    return RD.row_count(_r(spark, sf))


# --- W: windows -----------------------------------------------------------------


def q_next_speed(spark, sf):
    return ST.next_speed(_r(spark, sf).select("reading_id", "vehicle_tag", "report_time", "speed"))


def q_next_speed_one_vehicle(spark, sf):
    v = RD.for_vehicle(_r(spark, sf).select("reading_id", "vehicle_tag", "report_time", "speed"), VEHICLE)
    return ST.next_speed(v)


def q_last_moving_window(spark, sf):
    return ST.last_moving_window(_r(spark, sf).select("reading_id", "vehicle_tag", "report_time", "speed"))


# --- O: order / top-k -------------------------------------------------------------


def q_list_vehicles(spark, sf):
    return RP.list_vehicles(_r(spark, sf))


def q_top_stopped(spark, sf):
    stops = FL.stopped_vehicles(_r(spark, sf))
    return RP.top_rows(stops, TOP_K, [F.col("stopped_for").desc(), F.col("vehicle_tag"), F.col("report_time")])


# --- T: scalar time functions ---------------------------------------------------------


def q_stop_length_seconds(spark, sf):
    return _stop_lengths(spark, sf, TM.stop_length_seconds, False)


def q_stop_length_trunc(spark, sf):
    return _stop_lengths(spark, sf, TM.stop_length_trunc, True)


def q_stop_length_rounded(spark, sf):
    return _stop_lengths(spark, sf, TM.stop_length_rounded, True)


def q_hour_of_day(spark, sf):
    stops = FL.stopped_vehicles(_r(spark, sf))
    return RP.with_hour_of_day(stops)


def q_look_back_start(spark, sf):
    r = _r(spark, sf)
    qt = F.lit(QUERY_TIME).cast("timestamp_ntz")
    return r.filter(F.col("report_time").between(TM.look_back_start(QUERY_TIME, LOOK_BACK_MIN), qt)).select(
        "reading_id", "vehicle_tag", "report_time"
    )


def q_minutes_stopped(spark, sf):
    stops = FL.stopped_vehicles(_r(spark, sf))
    return stops.withColumn("minutes", TM.minutes_stopped("stopped_for"))


# --- C: comparison -------------------------------------------------------------------


def _deduped_hour_keys(spark, sf):
    """Comparison partner: the readings after hour truncation and dedupe (whole table)."""
    return RD.dedupe_readings(B.readings_hour_keys(spark, sf))


def q_count_diff(spark, sf):
    return CMP.count_diff(_r(spark, sf), _deduped_hour_keys(spark, sf))


def q_content_diff(spark, sf):
    return CMP.content_diff(_r(spark, sf), _deduped_hour_keys(spark, sf))


def q_content_diff_by_digest(spark, sf):
    """C4 of nearly equal tables: a few readings moved, lost or there twice."""
    r = _r(spark, sf)
    b = r.withColumn("latitude", F.when(F.col("reading_id") % 997 == 0, F.col("latitude") + 0.5).otherwise(F.col("latitude")))
    b = b.filter(F.col("reading_id") % 1999 != 5).unionByName(r.filter(F.col("reading_id") % 1511 == 7))
    return CMP.content_diff_by_digest(r, b)


def q_content_diff_ordered(spark, sf):
    """C4 ordered / J7: both tables in id order, compared position by position."""
    a = _r(spark, sf).orderBy("reading_id")
    b = _deduped_hour_keys(spark, sf).orderBy("reading_id")
    return CMP.content_diff(a, b, ordered=True)


def q_approx_diff(spark, sf):
    return CMP.approx_diff(_r(spark, sf), B.readings_speed_shifted(spark, sf), APPROX_TOL, key=["reading_id"])


def _special(df):
    """Readings with infinite, missing and NaN speeds among the others."""
    k = F.col("reading_id") % 7
    inf = F.lit(float("inf"))
    return df.withColumn("speed", F.when(k == 0, inf).when(k == 1, -inf).when(k == 2, F.lit(float("nan"))).when(k != 3, F.col("speed")))


def q_approx_diff_special(spark, sf):
    """C5 over infinities, NaN and NULL: speeds shifted where they are finite, a sign turned on every 35th reading."""
    r = _r(spark, sf).select("reading_id", "vehicle_tag", "speed")
    a = _special(r)
    b = _special(r.withColumn("speed", F.col("speed") + F.lit(0.0001)))
    b = b.withColumn("speed", F.when(F.col("reading_id") % 35 == 0, -F.col("speed")).otherwise(F.col("speed")))
    return CMP.approx_diff(a, b, APPROX_TOL, key=["reading_id"])


def q_content_diff_repeated(spark, sf):
    """C4 where one row is repeated very often: assignments and speeds' signs alone, against the moving ones."""
    r = _r(spark, sf).select("train_assignment", (F.col("speed") > 0).alias("moves"))
    return CMP.content_diff(r, r.filter("moves"))


def q_diff_with(spark, sf):
    """U4: readings whose coordinates differ by more than a tenth from the same vehicle position of the next id."""
    r = _r(spark, sf).select("reading_id", "latitude", "speed")
    b = r.withColumn("latitude", F.col("latitude") + (F.col("reading_id") % 3) * 0.05)
    near = lambda x, y: F.abs(x["latitude"] - y["latitude"]) < 0.075
    return CMP.diff_with(r, b, near, key=["reading_id"])


def _ranked(df):
    """The place of each row in the order that it comes in, where the order is the answer."""
    return CMP.with_row_index(df, "place")


def q_default_sort(spark, sf):
    return _ranked(CMP.default_sort(_r(spark, sf).select("vehicle_tag", "report_time", "reading_id")))


def q_stop_order(spark, sf):
    """O1/O3: places of all fleet stops, longest first."""
    stops = FL.stopped_vehicles(_r(spark, sf))
    return _ranked(stops.orderBy(F.col("stopped_for").desc(), "vehicle_tag", "report_time"))


def q_hour_order(spark, sf):
    """O3: the hours of the day with their places."""
    return _ranked(RP.hourly_stop_stats(FL.stopped_vehicles(_r(spark, sf))).select("hour_of_day", "stops"))


def q_current_stops_page(spark, sf):
    """A page smaller than the answer."""
    return CUR.current_stops(_r(spark, sf), QUERY_TIME, LOOK_BACK_MIN, PAGE_ROWS)


def q_history_page(spark, sf):
    """O5/Z9 over all stop times: a page smaller than the answer."""
    detail = FL.stops_detail(_r(spark, sf), max_id_gap=None)
    return HI.historical_stops(detail, HOUR, HIST_MIN_MIN, HIST_MAX_MIN, PAGE_ROWS)


def q_heat_page(spark, sf):
    """Heat points of a page smaller than the answer."""
    detail = FL.stops_detail(_r(spark, sf), max_id_gap=None)
    return HI.heat_points(detail, HOUR, HIST_MIN_MIN, HIST_MAX_MIN, PAGE_ROWS)


def _with_nulls(df):
    """Readings of which some have no vehicle and others no time."""
    k = F.col("reading_id") % 50
    vehicle = F.when(k != 7, F.col("vehicle_tag"))
    # One reading a vehicle at most without a time, so that the order among them is no question.
    first = F.col("reading_id") == F.min("reading_id").over(Window.partitionBy("vehicle_tag"))
    return df.withColumn("report_time", F.when(~(first & (k == 3)), F.col("report_time"))).withColumn("vehicle_tag", vehicle)


def q_next_speed_nulls(spark, sf):
    """W1 with readings that lack vehicle or time."""
    return ST.next_speed(_with_nulls(_r(spark, sf).select("reading_id", "vehicle_tag", "report_time", "speed")))


def q_find_last_stopped_nulls(spark, sf):
    """F3 with readings that lack vehicle or time."""
    return ST.find_last_stopped(_with_nulls(_r(spark, sf).select("reading_id", "vehicle_tag", "report_time", "speed")))


# --- places: stops near transit stops, out-of-range positions -------------------------


def q_stops_away_from_transit(spark, sf):
    """Long stops of the fleet that are not near a transit stop."""
    return NR.near(_detail(spark, sf), B.transit_stops(spark, sf), NEAR_M, away=True)


def q_stops_near_transit(spark, sf):
    """All stop times near transit stops: how many are in reach, and the nearest one's distance in whole metres."""
    stops = FL.stop_times(_r(spark, sf), with_location=True)
    found = NR.near_counts(stops, B.transit_stops(spark, sf), NEAR_M, ["vehicle_tag", "stopped_at"])
    return found.withColumn("nearest", F.round("nearest").cast("long"))


def q_readings_out_of_bounds(spark, sf):
    """Readings outside the bounds of all transit stops."""
    return NR.inside_bounds(_r(spark, sf), B.transit_stops(spark, sf), outside=True).select("reading_id", "latitude", "longitude")


# --- S15 / U1–U3: questions as SQL text over registered functions --------------------


def q_sql_list_stopped_vehicles(spark, sf):
    """The look-back question as a table function that SQL text calls."""
    SF.register_functions(spark, _r(spark, sf))
    return spark.sql(f"SELECT * FROM list_stopped_vehicles(TIMESTAMP_NTZ'{QUERY_TIME}', {LOOK_BACK_MIN})")


def q_sql_stopped_at_times(spark, sf):
    """U3 called once for each row of a table of query times."""
    SF.register_functions(spark, _r(spark, sf))
    times = ", ".join(f"(TIMESTAMP_NTZ'{t}')" for t in QUERY_TIMES)
    return spark.sql(f"SELECT q.query_time, s.* FROM VALUES {times} AS q(query_time), LATERAL list_stopped_vehicles(q.query_time, {LOOK_BACK_MIN}) AS s")


def q_sql_stops_between(spark, sf):
    """Z5 as a table function, with the scalar functions over its rows."""
    SF.register_functions(spark, _r(spark, sf))
    return spark.sql(
        "SELECT vehicle_tag, stopped_at, stopped_for, minutes_stopped(stopped_for) AS minutes, "
        "look_back_start(stopped_at, 30) AS half_hour_before, kept_text(concat('vehicle ', vehicle_tag)) AS label "
        f"FROM stops_between(TIMESTAMP_NTZ'{WINDOW_LOWER}', TIMESTAMP_NTZ'{WINDOW_UPPER}')"
    )


def q_sql_time_diff(spark, sf):
    """The three stop lengths of one vehicle's stops, from SQL text."""
    SF.register_functions(spark, _r(spark, sf))
    return spark.sql(
        "SELECT stopped_at, TimeDiff(stopped_since, stopped_at) AS exact, stop_seconds(stopped_since, stopped_at) AS clock, "
        f"stop_seconds_truncated(stopped_since, stopped_at) AS truncated FROM stops_of_vehicle('{VEHICLE}')"
    )


QUERIES: dict[str, Query] = {
    # composite questions
    "stopped_vehicles": q_stopped_vehicles,
    "ingest_avl": q_ingest_avl,
    "stopped_vehicle": q_stopped_vehicle,
    "stop_times": q_stop_times,
    "stops_in_window": q_stops_in_window,
    "list_stopped_vehicles": q_list_stopped_vehicles,
    "current_stops": q_current_stops,
    "stops_detail": q_stops_detail,
    "historical_stops": q_historical_stops,
    "map_points": q_map_points,
    "heat_points": q_heat_points,
    "vehicle_top_stops": q_vehicle_top_stops,
    # cleaning
    "drop_blank_lines": q_drop_blank_lines,
    "strip_header": q_strip_header,
    "split_fields": q_split_fields,
    "parse_report_time": q_parse_report_time,
    "empty_to_null_double": q_empty_to_null_double,
    "truncate_text": q_truncate_text,
    "promote_readings": q_promote_readings,
    "make_point": q_make_point,
    "substring_tail": q_substring_tail,
    "drop_last_char": q_drop_last_char,
    "dense_ids": q_dense_ids,
    "ingest_then_stops": q_ingest_then_stops,
    # filters
    "filter_moving": q_filter_moving,
    "filter_stopped": q_filter_stopped,
    "find_last_stopped": q_find_last_stopped,
    "long_stops": q_long_stops,
    "between_times": q_between_times,
    "for_vehicle": q_for_vehicle,
    "stops_at_hour": q_stops_at_hour,
    "long_stops_at_hour": q_long_stops_at_hour,
    # joins
    "last_moving_time": q_last_moving_time,
    "last_moving_time_unbounded": q_last_moving_time_unbounded,
    "last_moving_time_one_vehicle": q_last_moving_time_one_vehicle,
    "attach_by_time": q_attach_by_time,
    "attach_location": q_attach_location,
    "dedupe_readings": q_dedupe_readings,
    # aggregates
    "duplicate_keys": q_duplicate_keys,
    "speed_bounds": q_speed_bounds,
    "coordinate_bounds": q_coordinate_bounds,
    "transit_stop_bounds": q_transit_stop_bounds,
    "transit_stops": q_transit_stops,
    "trips": q_trips,
    "hourly_stop_stats": q_hourly_stop_stats,
    "distinct_vehicles": q_distinct_vehicles,
    "distinct_assignments": q_distinct_assignments,
    "row_count": q_row_count,
    "ids_follow_time": q_ids_follow_time,
    # windows
    "next_speed": q_next_speed,
    "next_speed_one_vehicle": q_next_speed_one_vehicle,
    "last_moving_window": q_last_moving_window,
    "next_speed_nulls": q_next_speed_nulls,
    "find_last_stopped_nulls": q_find_last_stopped_nulls,
    # order / top-k
    "list_vehicles": q_list_vehicles,
    "top_stopped": q_top_stopped,
    "default_sort": q_default_sort,
    "stop_order": q_stop_order,
    "hour_order": q_hour_order,
    "current_stops_page": q_current_stops_page,
    "history_page": q_history_page,
    "heat_page": q_heat_page,
    # places
    "stops_away_from_transit": q_stops_away_from_transit,
    "stops_near_transit": q_stops_near_transit,
    "readings_out_of_bounds": q_readings_out_of_bounds,
    # functions called from SQL text
    "sql_list_stopped_vehicles": q_sql_list_stopped_vehicles,
    "sql_stopped_at_times": q_sql_stopped_at_times,
    "sql_stops_between": q_sql_stops_between,
    "sql_time_diff": q_sql_time_diff,
    # scalar functions
    "stop_length_seconds": q_stop_length_seconds,
    "stop_length_trunc": q_stop_length_trunc,
    "stop_length_rounded": q_stop_length_rounded,
    "hour_of_day": q_hour_of_day,
    "look_back_start": q_look_back_start,
    "minutes_stopped": q_minutes_stopped,
    # comparison
    "count_diff": q_count_diff,
    "content_diff": q_content_diff,
    "content_diff_by_digest": q_content_diff_by_digest,
    "content_diff_ordered": q_content_diff_ordered,
    "approx_diff": q_approx_diff,
    "approx_diff_special": q_approx_diff_special,
    "content_diff_repeated": q_content_diff_repeated,
    "diff_with": q_diff_with,
    # tables kept batch by batch
    **BATCH_QUERIES,
}
