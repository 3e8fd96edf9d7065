"""DuckDB SQL twins of the registered queries (join forms, as the original SQL states them).

The tables of the driver are views with the same names. Each text restates a
question independently of the Spark code: stop ends with ``lead``, last moving
times with the per-vehicle inequality join and ``max``, lengths from epoch
microseconds.
"""

from __future__ import annotations

from .constants import RAW_HEADER
from .registry import (
    APPROX_TOL,
    DATA_LOWER,
    DATA_UPPER,
    HIST_MAX_MIN,
    HIST_MIN_MIN,
    HOUR,
    HOUR_MAX_S,
    HOUR_MIN_S,
    LOOK_BACK_MIN,
    NEAR_M,
    PAGE_ROWS,
    QUERY_TIME,
    QUERY_TIMES,
    RANGE_LOWER,
    RANGE_UPPER,
    TOP_K,
    VEHICLE,
    WINDOW_LOWER,
    WINDOW_UPPER,
)

SPEED = "CASE WHEN event_type IN ('view','click') THEN 0.0::DOUBLE ELSE value END"
LAT_TXT = "'37.' || CAST(700 + event_id % 137 AS VARCHAR)"
LON_TXT = "'-122.' || CAST(540 - event_id % 173 AS VARCHAR)"

READINGS = f"""readings AS (
  SELECT event_id AS reading_id, '1' AS rev, ts AS report_time, CAST(user_id AS VARCHAR) AS vehicle_tag,
         {SPEED} AS speed, CAST(event_id % 360 AS DOUBLE) AS heading, event_type AS train_assignment,
         CASE WHEN event_id % 10 = 0 THEN '0' ELSE '1' END AS predictable,
         CAST({LAT_TXT} AS DOUBLE) AS latitude, CAST({LON_TXT} AS DOUBLE) AS longitude
  FROM events)"""

HOUR_KEYS = """hk AS (
  SELECT reading_id, rev, date_trunc('hour', report_time) AS report_time, vehicle_tag, speed, heading,
         train_assignment, predictable, latitude, longitude FROM readings)"""

DEDUPED = """dd AS (
  SELECT * FROM hk
  QUALIFY vehicle_tag IS NULL OR report_time IS NULL
       OR row_number() OVER (PARTITION BY vehicle_tag, report_time ORDER BY reading_id DESC) = 1)"""

RAW = f"""lines AS (
  SELECT event_id,
         concat_ws(',', CAST(event_id AS VARCHAR), strftime(ts, '%m/%d/%Y %H:%M:%S'), CAST(user_id AS VARCHAR),
                   {LON_TXT}, {LAT_TXT},
                   CASE WHEN event_id % 50 = 0 THEN '' ELSE printf('%.2f', {SPEED}) END,
                   CAST(event_id % 360 AS VARCHAR), event_type,
                   CASE WHEN event_id % 10 = 0 THEN '0' ELSE '1' END) AS line
  FROM events),
raw AS (
  SELECT CASE WHEN event_id % 500 = 0 THEN '{RAW_HEADER}' || line ELSE line END AS value FROM lines
  UNION ALL SELECT '' AS value FROM events WHERE event_id % 2 = 0),
nonblank AS (SELECT value FROM raw WHERE value <> ''),
cleaned AS (SELECT replace(value, '{RAW_HEADER}', '') AS value FROM nonblank),
staging AS (
  SELECT p[1] AS rev, p[2] AS report_time, p[3] AS vehicle_tag, p[4] AS longitude, p[5] AS latitude,
         p[6] AS speed, p[7] AS heading, p[8] AS train_assignment, p[9] AS predictable
  FROM (SELECT string_split(value, ',') AS p FROM cleaned)),
promoted AS (
  SELECT TRY_CAST(rev AS BIGINT) AS reading_id, substring(rev, 1, 49) AS rev,
         strptime(report_time, '%m/%d/%Y %H:%M:%S') AS report_time, substring(vehicle_tag, 1, 49) AS vehicle_tag,
         CASE WHEN speed = '' THEN NULL ELSE CAST(speed AS DOUBLE) END AS speed,
         CASE WHEN heading = '' THEN NULL ELSE CAST(heading AS DOUBLE) END AS heading,
         substring(train_assignment, 1, 49) AS train_assignment, substring(predictable, 1, 49) AS predictable,
         CASE WHEN latitude = '' THEN NULL ELSE CAST(latitude AS DOUBLE) END AS latitude,
         CASE WHEN longitude = '' THEN NULL ELSE CAST(longitude AS DOUBLE) END AS longitude
  FROM staging)"""

ENDS = """ends AS (
  SELECT * FROM (SELECT *, lead(speed) OVER (PARTITION BY vehicle_tag ORDER BY report_time) AS next_speed
                 FROM {src}) WHERE speed = 0 AND next_speed > 0)"""

# Last moving time of stop ends with the id bound (the fleet job's join).
LM_GAP = """lm AS (
  SELECT s.vehicle_tag, s.report_time, max(m.report_time) AS last_moving_time
  FROM ends s JOIN {src} m
    ON s.vehicle_tag = m.vehicle_tag AND s.report_time > m.report_time AND s.reading_id - m.reading_id < 300
  WHERE m.speed > 0 GROUP BY s.vehicle_tag, s.report_time)"""

# Without the id bound.
LM_ALL = """lm AS (
  SELECT s.vehicle_tag, s.report_time, max(m.report_time) AS last_moving_time
  FROM ends s JOIN {src} m ON s.vehicle_tag = m.vehicle_tag AND s.report_time > m.report_time
  WHERE m.speed > 0 GROUP BY s.vehicle_tag, s.report_time)"""

T1 = "date_diff('second', {b}, {a})"
T2 = "((epoch_us({a}) // 1000 - epoch_us({b}) // 1000) // 1000)"
T3 = "CAST(round_even((epoch_us({a}) - epoch_us({b})) / 1000000.0, 0) AS INTEGER)"


def _t(tmpl: str, a: str, b: str) -> str:
    return tmpl.format(a=a, b=b)


IN_RANGE = f"report_time BETWEEN TIMESTAMP '{DATA_LOWER}' AND TIMESTAMP '{DATA_UPPER}'"

def _fleet(src: str) -> str:
    """Long stops of table ``src``, all of it."""
    return f"""{ENDS.format(src=src)},
{LM_GAP.format(src=src)},
stops AS (
  SELECT report_time, vehicle_tag, stopped_for FROM (
    SELECT *, {_t(T1, 'report_time', 'last_moving_time')} AS stopped_for FROM lm)
  WHERE stopped_for > 300 AND stopped_for < 7200)"""


#: The fleet's long stops without time bounds.
FLEET_ALL = f"WITH {READINGS},\n{_fleet('readings')}"

#: Raw lines ingested without given ids: numbered in the order of time and then of the other columns.
INGESTED = f"""{RAW},
typed AS (SELECT * EXCLUDE (reading_id) FROM promoted),
numbered AS (
  SELECT row_number() OVER (ORDER BY report_time, rev, vehicle_tag, speed NULLS FIRST, heading, train_assignment, predictable,
                                     latitude, longitude) AS reading_id, * FROM typed),
ingested AS (
  SELECT * FROM numbered QUALIFY row_number() OVER (PARTITION BY vehicle_tag, report_time ORDER BY reading_id DESC) = 1)"""

#: Readings of which some lack vehicle or time.
NULLED = """nulled AS (
  SELECT reading_id, CASE WHEN reading_id % 50 <> 7 THEN vehicle_tag END AS vehicle_tag,
         CASE WHEN NOT (reading_id = min(reading_id) OVER (PARTITION BY vehicle_tag) AND reading_id % 50 = 3) THEN report_time END AS report_time,
         speed FROM readings)"""
NEXT_NULLED = "lead(speed) OVER (PARTITION BY vehicle_tag ORDER BY report_time NULLS FIRST) AS next_speed"

#: All stop times with hour and place (the history pages without the id bound).
ALL_DETAIL = f"""WITH {READINGS},
{ENDS.format(src='readings')},
{LM_ALL.format(src='readings')},
detail AS (
  SELECT s.report_time, s.vehicle_tag, s.stopped_for, CAST(hour(s.report_time) AS INTEGER) AS hour_of_day, a.latitude, a.longitude
  FROM (SELECT *, {_t(T1, 'report_time', 'last_moving_time')} AS stopped_for FROM lm) s
  JOIN readings a ON s.vehicle_tag = a.vehicle_tag AND s.report_time = a.report_time
  WHERE s.stopped_for > 300 AND s.stopped_for < 7200)"""

SPECIAL = """CASE reading_id % 7 WHEN 0 THEN 'inf'::DOUBLE WHEN 1 THEN '-inf'::DOUBLE WHEN 2 THEN 'nan'::DOUBLE WHEN 3 THEN NULL ELSE {s} END"""

FLEET = f"""WITH {READINGS},
r AS (SELECT * FROM readings WHERE {IN_RANGE}),
{ENDS.format(src='r')},
{LM_GAP.format(src='r')},
stops AS (
  SELECT report_time, vehicle_tag, stopped_for FROM (
    SELECT *, {_t(T1, 'report_time', 'last_moving_time')} AS stopped_for FROM lm)
  WHERE stopped_for > 300 AND stopped_for < 7200)"""

DETAIL = f"""WITH {READINGS},
{ENDS.format(src='readings')},
{LM_GAP.format(src='readings')},
stops AS (
  SELECT report_time, vehicle_tag, stopped_for FROM (
    SELECT *, {_t(T1, 'report_time', 'last_moving_time')} AS stopped_for FROM lm)
  WHERE stopped_for > 300 AND stopped_for < 7200),
detail AS (
  SELECT s.report_time, s.vehicle_tag, s.stopped_for, CAST(hour(s.report_time) AS INTEGER) AS hour_of_day,
         a.latitude, a.longitude
  FROM stops s JOIN readings a ON s.vehicle_tag = a.vehicle_tag AND s.report_time = a.report_time)"""

STOP_TIMES = f"""WITH {READINGS},
{ENDS.format(src='readings')},
{LM_ALL.format(src='readings')},
stop_times AS (
  SELECT vehicle_tag, report_time AS stopped_at, last_moving_time AS stopped_since,
         {_t(T3, 'report_time', 'last_moving_time')} AS stopped_for FROM lm)"""

_QT = f"TIMESTAMP '{QUERY_TIME}'"
_BEGIN = f"({_QT} - INTERVAL {LOOK_BACK_MIN} MINUTE)"


def _look_back(query_time: str) -> str:
    """Stops listed at a query time (a SQL expression), from the look-back range alone."""
    begin = f"({query_time} - INTERVAL {LOOK_BACK_MIN} MINUTE)"
    return f"""WITH {READINGS},
window_stop_ends AS (
  SELECT vehicle_tag, report_time FROM (
    SELECT vehicle_tag, report_time, speed,
           lead(speed, 1) OVER (PARTITION BY vehicle_tag ORDER BY report_time) AS next_speed
    FROM readings WHERE report_time BETWEEN {begin} AND {query_time})
  WHERE speed = 0 AND next_speed > 0),
window_moving AS (
  SELECT vehicle_tag, report_time FROM readings WHERE report_time BETWEEN {begin} AND {query_time} AND speed > 0),
window_last_moving AS (
  SELECT s.vehicle_tag, s.report_time AS stopped_at, max(m.report_time) AS stopped_since
  FROM window_stop_ends s JOIN window_moving m ON s.vehicle_tag = m.vehicle_tag
  WHERE s.report_time > m.report_time GROUP BY s.vehicle_tag, s.report_time),
listed AS (
  SELECT st.vehicle_tag AS veh_tag, avl.train_assignment AS train_asng, st.stopped_at,
         {_t(T3, 'st.stopped_at', 'st.stopped_since')} AS stopped_for, avl.latitude AS lat, avl.longitude AS lon
  FROM window_last_moving st JOIN readings avl ON st.vehicle_tag = avl.vehicle_tag AND st.stopped_at = avl.report_time
  WHERE avl.report_time BETWEEN {begin} AND {query_time})"""


LOOK_BACK = _look_back(_QT)

VEH = f"""WITH {READINGS},
v AS (SELECT * FROM readings WHERE vehicle_tag = '{VEHICLE}')"""

MIN_LEN = 60 * HIST_MIN_MIN
MAX_LEN = 60 * HIST_MAX_MIN

#: Transit stops, and a distance in metres between positions a and b, pair by pair.
PLACES = f"""places AS (
  SELECT CAST({LAT_TXT.replace('event_id', 's_suppkey')} AS DOUBLE) AS stop_lat, CAST({LON_TXT.replace('event_id', 's_suppkey')} AS DOUBLE) AS stop_lon FROM supplier)"""
METRES = """2 * 6371008.8 * asin(sqrt(least(1.0, pow(sin(radians(b.stop_lat - a.latitude) / 2), 2)
  + cos(radians(a.latitude)) * cos(radians(b.stop_lat)) * pow(sin(radians(b.stop_lon - a.longitude) / 2), 2))))"""

LISTED_AT = "\nUNION ALL\n".join(f"(SELECT {at} AS query_time, * FROM ({_look_back(at)} SELECT * FROM listed))" for at in (f"TIMESTAMP '{t}'" for t in QUERY_TIMES))

SQL: dict[str, str] = {
    # composite questions
    "stopped_vehicles": f"{FLEET} SELECT * FROM stops",
    "ingest_avl": f"""WITH {RAW}
SELECT * FROM promoted
QUALIFY vehicle_tag IS NULL OR report_time IS NULL
     OR row_number() OVER (PARTITION BY vehicle_tag, report_time ORDER BY reading_id DESC) = 1""",
    "stopped_vehicle": f"""{VEH},
stopped AS (SELECT * FROM v WHERE speed = 0),
moving AS (SELECT * FROM v WHERE speed > 0),
lmi AS (
  SELECT s.report_time, max(m.report_time) AS last_moving_time
  FROM stopped s JOIN moving m ON s.report_time > m.report_time GROUP BY s.report_time),
info AS (SELECT *, {_t(T2, 'report_time', 'last_moving_time')} AS stopped_for FROM lmi),
{ENDS.format(src='v')}
SELECT e.reading_id, e.report_time, e.vehicle_tag, e.speed, e.train_assignment, e.latitude, e.longitude,
       i.last_moving_time, i.stopped_for
FROM ends e JOIN info i ON e.report_time = i.report_time""",
    "stop_times": f"{STOP_TIMES} SELECT * FROM stop_times",
    "stops_in_window": f"""{STOP_TIMES}
SELECT st.vehicle_tag, st.stopped_at, st.stopped_for, sa.latitude, sa.longitude
FROM stop_times st JOIN readings sa ON st.vehicle_tag = sa.vehicle_tag AND st.stopped_at = sa.report_time
WHERE st.stopped_at BETWEEN TIMESTAMP '{WINDOW_LOWER}' AND TIMESTAMP '{WINDOW_UPPER}'
ORDER BY st.stopped_for DESC""",
    "list_stopped_vehicles": f"{LOOK_BACK} SELECT * FROM listed ORDER BY stopped_for DESC",
    "current_stops": f"""{LOOK_BACK}
SELECT veh_tag AS vehicle_tag, coalesce(train_asng, '') AS train_assignment,
       strftime(stopped_at, '%Y-%m-%d %H:%M:%S') AS stopped_at, round(stopped_for / 60.0::DOUBLE, 1) AS minutes,
       lat AS latitude, lon AS longitude
FROM listed ORDER BY stopped_for DESC, veh_tag, listed.stopped_at LIMIT 500""",
    "stops_detail": f"{DETAIL} SELECT * FROM detail",
    "historical_stops": f"""{DETAIL}
SELECT vehicle_tag, report_time, stopped_for, round(stopped_for / 60.0::DOUBLE, 1) AS minutes, hour_of_day,
       latitude, longitude
FROM detail WHERE hour_of_day = {HOUR} AND stopped_for >= {MIN_LEN} AND stopped_for <= {MAX_LEN}
ORDER BY stopped_for DESC, vehicle_tag, report_time LIMIT 300""",
    "map_points": f"""{LOOK_BACK}
SELECT veh_tag AS tag, lat, lon AS lng, round(stopped_for / 60.0::DOUBLE, 1) AS minutes
FROM listed ORDER BY stopped_for DESC, veh_tag, stopped_at LIMIT 25""",
    "heat_points": f"""{DETAIL}
SELECT lat, lng FROM (
  SELECT latitude AS lat, longitude AS lng FROM detail
  WHERE hour_of_day = {HOUR} AND stopped_for >= {MIN_LEN} AND stopped_for <= {MAX_LEN}
  ORDER BY stopped_for DESC, vehicle_tag, report_time LIMIT 3000)""",
    "vehicle_top_stops": f"""{VEH},
{ENDS.format(src='v')},
vehicle_stops AS (
  SELECT s.report_time AS stopped_at, max(m.report_time) AS stopped_since
  FROM ends s JOIN v m ON s.report_time > m.report_time WHERE m.speed > 0 GROUP BY s.report_time)
SELECT sa.report_time, sa.latitude, sa.longitude, {_t(T3, 'vs.stopped_at', 'vs.stopped_since')} AS stopped_for
FROM v sa JOIN vehicle_stops vs ON sa.report_time = vs.stopped_at
ORDER BY stopped_for DESC""",
    # places
    "stops_away_from_transit": f"""{DETAIL}, {PLACES}
SELECT * FROM detail a WHERE NOT EXISTS (SELECT 1 FROM places b WHERE {METRES} <= {NEAR_M})""",
    "stops_near_transit": f"""{STOP_TIMES}, {PLACES},
a AS (SELECT st.*, r.latitude, r.longitude FROM stop_times st JOIN readings r ON st.vehicle_tag = r.vehicle_tag AND st.stopped_at = r.report_time),
pairs AS (SELECT vehicle_tag, stopped_at, {METRES} AS d FROM a, places b)
SELECT vehicle_tag, stopped_at, count(*) AS places, CAST(round(min(d)) AS BIGINT) AS nearest
FROM pairs WHERE d <= {NEAR_M} GROUP BY vehicle_tag, stopped_at""",
    "readings_out_of_bounds": f"""WITH {READINGS}, {PLACES},
bounds AS (SELECT min(stop_lat) AS a0, max(stop_lat) AS a1, min(stop_lon) AS o0, max(stop_lon) AS o1 FROM places)
SELECT reading_id, latitude, longitude FROM readings, bounds WHERE NOT (latitude BETWEEN a0 AND a1 AND longitude BETWEEN o0 AND o1)""",
    # functions called from SQL text
    "sql_list_stopped_vehicles": f"{LOOK_BACK} SELECT * FROM listed",
    "sql_stopped_at_times": LISTED_AT,
    "sql_stops_between": f"""{STOP_TIMES}
SELECT st.vehicle_tag, st.stopped_at, st.stopped_for, round(st.stopped_for / 60.0::DOUBLE, 1) AS minutes,
       st.stopped_at - INTERVAL 30 MINUTE AS half_hour_before, 'vehicle ' || st.vehicle_tag AS label
FROM stop_times st WHERE st.stopped_at BETWEEN TIMESTAMP '{WINDOW_LOWER}' AND TIMESTAMP '{WINDOW_UPPER}'""",
    "sql_time_diff": f"""{STOP_TIMES}
SELECT stopped_at, stopped_for AS exact, {_t(T1, 'stopped_at', 'stopped_since')} AS clock,
       CAST({_t(T2, 'stopped_at', 'stopped_since')} AS BIGINT) AS truncated
FROM stop_times WHERE vehicle_tag = '{VEHICLE}'""",
    # tables kept batch by batch: as one pass gives them
    "stop_times_by_batch": f"""{STOP_TIMES}
SELECT st.*, r.latitude, r.longitude
FROM stop_times st JOIN readings r ON st.vehicle_tag = r.vehicle_tag AND st.stopped_at = r.report_time""",
    "stops_detail_by_batch": f"{DETAIL} SELECT * FROM detail",
    "stored_bounds": f"""WITH {READINGS}
SELECT count(*) AS row_count, min(speed) AS min_speed, max(speed) AS max_speed, min(latitude) AS min_latitude,
       max(latitude) AS max_latitude, min(longitude) AS min_longitude, max(longitude) AS max_longitude FROM readings""",
    "upsert_readings": f"WITH {READINGS}, {HOUR_KEYS}, {DEDUPED} SELECT * FROM dd",
    "refresh_values": f"""WITH {READINGS}, {HOUR_KEYS}, {DEDUPED},
v AS (
  SELECT unnest(['vehicle_tag', 'train_assignment', 'heading']) AS "column",
         unnest([vehicle_tag, train_assignment, CAST(heading AS VARCHAR)]) AS value FROM dd)
SELECT "column", value, count(*) AS "rows" FROM v GROUP BY ALL""",
    # cleaning
    "drop_blank_lines": f"WITH {RAW} SELECT value FROM nonblank",
    "strip_header": f"WITH {RAW} SELECT value FROM cleaned",
    "split_fields": f"WITH {RAW} SELECT * FROM staging",
    "parse_report_time": f"WITH {RAW} SELECT rev, strptime(report_time, '%m/%d/%Y %H:%M:%S') AS report_time FROM staging",
    "empty_to_null_double": f"""WITH {RAW}
SELECT rev, CASE WHEN speed = '' THEN NULL ELSE CAST(speed AS DOUBLE) END AS speed,
       CASE WHEN latitude = '' THEN NULL ELSE CAST(latitude AS DOUBLE) END AS latitude,
       CASE WHEN longitude = '' THEN NULL ELSE CAST(longitude AS DOUBLE) END AS longitude
FROM staging""",
    "truncate_text": f"""WITH {RAW}
SELECT rev, substring(vehicle_tag, 1, 49) AS vehicle_tag, substring(train_assignment, 1, 49) AS train_assignment
FROM staging""",
    "promote_readings": f"WITH {RAW} SELECT * FROM promoted",
    "make_point": f"""WITH {RAW}
SELECT rev, CAST(latitude AS DOUBLE) AS lat, CAST(longitude AS DOUBLE) AS lon FROM staging""",
    "substring_tail": f"""WITH {RAW}
SELECT substring(value, {len(RAW_HEADER) + 1}) AS value FROM nonblank""",
    "drop_last_char": f"WITH {RAW} SELECT substring(value, 1, length(value) - 1) AS value FROM raw",
    "dense_ids": f"WITH {INGESTED} SELECT reading_id, rev, report_time, vehicle_tag FROM numbered",
    "ingest_then_stops": f"WITH {INGESTED},\n{_fleet('ingested')} SELECT * FROM stops",
    # filters
    "filter_moving": f"WITH {READINGS} SELECT reading_id, vehicle_tag, report_time, speed FROM readings WHERE speed > 0",
    "filter_stopped": f"WITH {READINGS} SELECT reading_id, vehicle_tag, report_time, speed FROM readings WHERE speed = 0",
    "find_last_stopped": f"""WITH {READINGS},
r AS (SELECT reading_id, vehicle_tag, report_time, speed FROM readings),
{ENDS.format(src='r')}
SELECT * FROM ends""",
    "long_stops": f"""WITH {READINGS},
{ENDS.format(src='readings')},
{LM_ALL.format(src='readings')}
SELECT report_time, vehicle_tag, stopped_for FROM (
  SELECT *, {_t(T1, 'report_time', 'last_moving_time')} AS stopped_for FROM lm)
WHERE stopped_for > 300 AND stopped_for < 7200""",
    "between_times": f"""WITH {READINGS}
SELECT reading_id, vehicle_tag, report_time FROM readings
WHERE report_time BETWEEN TIMESTAMP '{RANGE_LOWER}' AND TIMESTAMP '{RANGE_UPPER}'""",
    "for_vehicle": f"WITH {READINGS} SELECT * FROM readings WHERE vehicle_tag = '{VEHICLE}'",
    "stops_at_hour": f"""{DETAIL}
SELECT * FROM detail WHERE hour_of_day = {HOUR} AND stopped_for >= {HOUR_MIN_S} AND stopped_for <= {HOUR_MAX_S}""",
    "long_stops_at_hour": f"""{DETAIL}
SELECT vehicle_tag, report_time, stopped_for, latitude, longitude FROM detail
WHERE hour_of_day = {HOUR} AND stopped_for > 600""",
    # joins
    "last_moving_time": f"""WITH {READINGS},
{ENDS.format(src='readings')},
{LM_GAP.format(src='readings')}
SELECT * FROM lm""",
    "last_moving_time_unbounded": f"""WITH {READINGS}
SELECT s.vehicle_tag, s.report_time, max(m.report_time) AS last_moving_time
FROM readings s JOIN readings m ON s.vehicle_tag = m.vehicle_tag AND s.report_time > m.report_time
WHERE s.speed = 0 AND m.speed > 0 GROUP BY s.vehicle_tag, s.report_time""",
    "last_moving_time_one_vehicle": f"""{VEH},
{ENDS.format(src='v')}
SELECT s.report_time AS stopped_at, max(m.report_time) AS stopped_since,
       {_t(T3, 's.report_time', 'max(m.report_time)')} AS stopped_for
FROM ends s JOIN v m ON s.report_time > m.report_time WHERE m.speed > 0 GROUP BY s.report_time""",
    "attach_by_time": f"""{VEH},
{ENDS.format(src='v')},
lmi AS (
  SELECT s.report_time, max(m.report_time) AS last_moving_time
  FROM v s JOIN v m ON s.report_time > m.report_time WHERE s.speed = 0 AND m.speed > 0 GROUP BY s.report_time)
SELECT e.reading_id, e.report_time, i.last_moving_time, {_t(T2, 'i.report_time', 'i.last_moving_time')} AS stopped_for
FROM ends e JOIN lmi i ON e.report_time = i.report_time""",
    "attach_location": f"""{FLEET_ALL}
SELECT s.vehicle_tag, s.report_time, s.stopped_for, a.latitude, a.longitude
FROM stops s JOIN readings a ON s.vehicle_tag = a.vehicle_tag AND s.report_time = a.report_time""",
    "dedupe_readings": f"""WITH {READINGS}, {HOUR_KEYS}
SELECT * FROM hk
QUALIFY vehicle_tag IS NULL OR report_time IS NULL
     OR row_number() OVER (PARTITION BY vehicle_tag, report_time ORDER BY reading_id DESC) = 1""",
    # aggregates
    "duplicate_keys": f"""WITH {READINGS}, {HOUR_KEYS}
SELECT vehicle_tag, report_time, count(*) AS n FROM hk GROUP BY vehicle_tag, report_time HAVING count(*) > 1""",
    "speed_bounds": f"WITH {READINGS} SELECT min(speed) AS min_speed, max(speed) AS max_speed FROM readings",
    "coordinate_bounds": f"""WITH {READINGS}
SELECT min(latitude) AS min_lat, max(latitude) AS max_lat, min(longitude) AS min_lon, max(longitude) AS max_lon
FROM readings""",
    "transit_stop_bounds": """WITH s AS (
  SELECT CAST('37.' || CAST(700 + s_suppkey % 137 AS VARCHAR) AS DOUBLE) AS stop_lat,
         CAST('-122.' || CAST(540 - s_suppkey % 173 AS VARCHAR) AS DOUBLE) AS stop_lon FROM supplier)
SELECT min(stop_lat) AS min_lat, max(stop_lat) AS max_lat, min(stop_lon) AS min_lon, max(stop_lon) AS max_lon FROM s""",
    "transit_stops": """SELECT CAST(s_suppkey AS VARCHAR) AS stop_id, s_name AS stop_name,
  CAST('37.' || CAST(700 + s_suppkey % 137 AS VARCHAR) AS DOUBLE) AS stop_lat,
  CAST('-122.' || CAST(540 - s_suppkey % 173 AS VARCHAR) AS DOUBLE) AS stop_lon, CAST(s_nationkey AS VARCHAR) AS zone_id FROM supplier""",
    "trips": """SELECT CAST(o_orderkey AS VARCHAR) AS trip_id, o_orderpriority AS route_id, CAST(o_custkey AS VARCHAR) AS block_id,
  o_orderstatus AS direction_id FROM orders""",
    "hourly_stop_stats": f"""{FLEET_ALL}
SELECT CAST(hour(report_time) AS INTEGER) AS hour_of_day, count(*) AS stops, avg(stopped_for) AS avg_stopped_for
FROM stops GROUP BY 1 ORDER BY 1""",
    "distinct_vehicles": f"WITH {READINGS} SELECT DISTINCT vehicle_tag FROM readings",
    "distinct_assignments": f"WITH {READINGS} SELECT DISTINCT train_assignment FROM readings",
    "row_count": f"WITH {READINGS} SELECT count(*) AS row_count FROM readings",
    "ids_follow_time": f"""WITH {READINGS}, {HOUR_KEYS},
ordered AS (
  SELECT reading_id, max(reading_id) OVER (PARTITION BY vehicle_tag ORDER BY report_time, reading_id
                                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_max
  FROM hk WHERE vehicle_tag IS NOT NULL AND report_time IS NOT NULL),
ties AS (
  SELECT count(*) AS n FROM (SELECT vehicle_tag, report_time FROM hk
                             WHERE vehicle_tag IS NOT NULL AND report_time IS NOT NULL
                             GROUP BY 1, 2 HAVING count(*) > 1))
SELECT (SELECT count(*) FROM ordered WHERE reading_id <= prev_max) AS violations,
       (SELECT n FROM ties) AS tied_times""",
    # windows
    "next_speed": f"""WITH {READINGS}
SELECT reading_id, vehicle_tag, report_time, speed,
       lead(speed) OVER (PARTITION BY vehicle_tag ORDER BY report_time) AS next_speed FROM readings""",
    "next_speed_one_vehicle": f"""{VEH}
SELECT reading_id, vehicle_tag, report_time, speed, lead(speed) OVER (ORDER BY report_time) AS next_speed FROM v""",
    "last_moving_window": f"""WITH {READINGS}
SELECT reading_id, vehicle_tag, report_time, last_moving_time FROM (
  SELECT *, max(CASE WHEN speed > 0 THEN report_time END) OVER (
           PARTITION BY vehicle_tag ORDER BY report_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
         AS last_moving_time
  FROM readings) WHERE speed = 0""",
    "next_speed_nulls": f"WITH {READINGS}, {NULLED} SELECT *, {NEXT_NULLED} FROM nulled",
    "find_last_stopped_nulls": f"""WITH {READINGS}, {NULLED}
SELECT * FROM (SELECT *, {NEXT_NULLED} FROM nulled) WHERE speed = 0 AND next_speed > 0""",
    # order / top-k
    "default_sort": f"""WITH {READINGS}
SELECT row_number() OVER (ORDER BY reading_id, report_time, vehicle_tag) - 1 AS place, vehicle_tag, report_time, reading_id FROM readings""",
    "stop_order": f"""{FLEET_ALL}
SELECT row_number() OVER (ORDER BY stopped_for DESC, vehicle_tag, report_time) - 1 AS place, * FROM stops""",
    "hour_order": f"""{FLEET_ALL}
SELECT row_number() OVER (ORDER BY hour_of_day) - 1 AS place, * FROM (
  SELECT CAST(hour(report_time) AS INTEGER) AS hour_of_day, count(*) AS stops FROM stops GROUP BY 1)""",
    "current_stops_page": f"""{LOOK_BACK}
SELECT veh_tag AS vehicle_tag, coalesce(train_asng, '') AS train_assignment,
       strftime(stopped_at, '%Y-%m-%d %H:%M:%S') AS stopped_at, round(stopped_for / 60.0::DOUBLE, 1) AS minutes,
       lat AS latitude, lon AS longitude
FROM listed ORDER BY stopped_for DESC, veh_tag, listed.stopped_at LIMIT {PAGE_ROWS}""",
    "history_page": f"""{ALL_DETAIL}
SELECT vehicle_tag, report_time, stopped_for, round(stopped_for / 60.0::DOUBLE, 1) AS minutes, hour_of_day, latitude, longitude
FROM detail WHERE hour_of_day = {HOUR} AND stopped_for >= {MIN_LEN} AND stopped_for <= {MAX_LEN}
ORDER BY stopped_for DESC, vehicle_tag, report_time LIMIT {PAGE_ROWS}""",
    "heat_page": f"""{ALL_DETAIL}
SELECT latitude AS lat, longitude AS lng FROM detail
WHERE hour_of_day = {HOUR} AND stopped_for >= {MIN_LEN} AND stopped_for <= {MAX_LEN}
ORDER BY stopped_for DESC, vehicle_tag, report_time LIMIT {PAGE_ROWS}""",
    "list_vehicles": f"WITH {READINGS} SELECT DISTINCT vehicle_tag FROM readings ORDER BY vehicle_tag",
    "top_stopped": f"{FLEET_ALL} SELECT * FROM stops ORDER BY stopped_for DESC, vehicle_tag, report_time LIMIT {TOP_K}",
    # scalar functions
    "stop_length_seconds": f"""WITH {READINGS}, {ENDS.format(src='readings')}, {LM_ALL.format(src='readings')}
SELECT vehicle_tag, report_time, last_moving_time, {_t(T1, 'report_time', 'last_moving_time')} AS stopped_for FROM lm""",
    "stop_length_trunc": f"""WITH {READINGS}, {ENDS.format(src='readings')}, {LM_ALL.format(src='readings')}
SELECT vehicle_tag, report_time, last_moving_time, {_t(T2, 'report_time', 'last_moving_time')} AS stopped_for FROM lm""",
    "stop_length_rounded": f"""WITH {READINGS}, {ENDS.format(src='readings')}, {LM_ALL.format(src='readings')}
SELECT vehicle_tag, report_time, last_moving_time, {_t(T3, 'report_time', 'last_moving_time')} AS stopped_for FROM lm""",
    "hour_of_day": f"{FLEET_ALL} SELECT *, CAST(hour(report_time) AS INTEGER) AS hour_of_day FROM stops",
    "look_back_start": f"""WITH {READINGS}
SELECT reading_id, vehicle_tag, report_time FROM readings WHERE report_time BETWEEN {_BEGIN} AND {_QT}""",
    "minutes_stopped": f"{FLEET_ALL} SELECT *, round(stopped_for / 60.0::DOUBLE, 1) AS minutes FROM stops",
    # comparison
    "count_diff": f"""WITH {READINGS}, {HOUR_KEYS}, {DEDUPED}
SELECT (SELECT count(*) FROM readings) AS count_a, (SELECT count(*) FROM dd) AS count_b,
       (SELECT count(*) FROM readings) = (SELECT count(*) FROM dd) AS equal""",
    "content_diff": f"""WITH {READINGS}, {HOUR_KEYS}, {DEDUPED}
SELECT *, 'a' AS side FROM (SELECT * FROM readings EXCEPT ALL SELECT * FROM dd)
UNION ALL
SELECT *, 'b' AS side FROM (SELECT * FROM dd EXCEPT ALL SELECT * FROM readings)""",
    "content_diff_by_digest": f"""WITH {READINGS},
b AS (SELECT * REPLACE (CASE WHEN reading_id % 997 = 0 THEN latitude + 0.5::DOUBLE ELSE latitude END AS latitude)
      FROM readings WHERE reading_id % 1999 <> 5
      UNION ALL SELECT * FROM readings WHERE reading_id % 1511 = 7)
SELECT *, 'a' AS side FROM (SELECT * FROM readings EXCEPT ALL SELECT * FROM b)
UNION ALL
SELECT *, 'b' AS side FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM readings)""",
    "content_diff_ordered": f"""WITH {READINGS}, {HOUR_KEYS}, {DEDUPED},
a AS (SELECT row_number() OVER (ORDER BY reading_id) - 1 AS row_index, * FROM readings),
b AS (SELECT row_number() OVER (ORDER BY reading_id) - 1 AS row_index, * FROM dd),
j AS (
  SELECT a.row_index AS ia, b.row_index AS ib, a, b FROM a FULL OUTER JOIN b ON a.row_index = b.row_index
  WHERE a IS NULL OR b IS NULL
     OR (a.reading_id, a.rev, a.report_time, a.vehicle_tag, a.speed, a.heading, a.train_assignment, a.predictable,
         a.latitude, a.longitude)
        IS DISTINCT FROM
        (b.reading_id, b.rev, b.report_time, b.vehicle_tag, b.speed, b.heading, b.train_assignment, b.predictable,
         b.latitude, b.longitude))
SELECT unnest(a), 'a' AS side FROM j WHERE ia IS NOT NULL
UNION ALL
SELECT unnest(b), 'b' AS side FROM j WHERE ib IS NOT NULL""",
    "approx_diff": f"""WITH {READINGS},
b AS (SELECT reading_id, speed + 0.0001 AS speed FROM readings)
SELECT a.reading_id, 'both' AS side, 'speed' AS columns
FROM readings a JOIN b ON a.reading_id = b.reading_id
WHERE abs(a.speed - b.speed) > {APPROX_TOL}""",
    "approx_diff_special": f"""WITH {READINGS},
a AS (SELECT reading_id, {SPECIAL.format(s='speed')} AS speed FROM readings),
b AS (SELECT reading_id, CASE WHEN reading_id % 35 = 0 THEN -({SPECIAL.format(s='speed + 0.0001')})
                              ELSE {SPECIAL.format(s='speed + 0.0001')} END AS speed FROM readings)
SELECT a.reading_id, 'both' AS side, 'speed' AS columns FROM a JOIN b ON a.reading_id = b.reading_id
WHERE (a.speed IS NULL) <> (b.speed IS NULL)
   OR (a.speed <> b.speed AND (isinf(a.speed) OR isinf(b.speed) OR isnan(a.speed) <> isnan(b.speed) OR abs(a.speed - b.speed) > {APPROX_TOL}))""",
    "content_diff_repeated": f"""WITH {READINGS},
r AS (SELECT train_assignment, speed > 0 AS moves FROM readings)
SELECT *, 'a' AS side FROM (SELECT * FROM r EXCEPT ALL SELECT * FROM r WHERE moves)
UNION ALL SELECT *, 'b' AS side FROM (SELECT * FROM r WHERE moves EXCEPT ALL SELECT * FROM r)""",
    "diff_with": f"""WITH {READINGS}
SELECT reading_id, 'both' AS side FROM readings WHERE abs(latitude - (latitude + (reading_id % 3) * 0.05::DOUBLE)) >= 0.075::DOUBLE""",
}
