"""Stop questions as functions that SQL text can call, scalar ones and ones that return tables.

:func:`register_functions` names a readings table and creates Spark SQL functions over it for the session. Their bodies
are SQL, which Spark expands into the caller's plan: no Python runs, arguments that are constants reach the scan as
pushed filters, and arguments may be columns of another table (``FROM times t, LATERAL list_stopped_vehicles(t.at, 60)``).

The table functions share one body, the history scan in SQL: windows per (vehicle, day) and one summary row per vehicle
and day that carries the last moving time and the next speed across midnight, so that a vehicle with very many
readings is as many pieces as it has days. Times are wall-clock times: no function depends on the session's time zone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..constants import TEXT_KEEP_CHARS

#: Seconds between two times with their fraction, from the parts of the interval.
_SECONDS = (
    "((extract(DAY FROM {b} - {a}) * 24 + extract(HOUR FROM {b} - {a})) * 60 + extract(MINUTE FROM {b} - {a})) * 60"
    " + extract(SECOND FROM {b} - {a})"
)


def _between(a: str, b: str) -> str:
    return _SECONDS.format(a=a, b=b)


def _floored(unit: str) -> str:
    return _between(f"date_trunc('{unit}', start_t)", f"date_trunc('{unit}', end_t)")


#: name: (parameters, result, body). T1 to T3, T5, T6, P7 and P14 of the cleaning and time functions.
SCALAR = {
    "TimeDiff": ("start_t TIMESTAMP_NTZ, end_t TIMESTAMP_NTZ", "INT", f"CAST(bround({_between('start_t', 'end_t')}, 0) AS INT)"),
    "stop_seconds": ("start_t TIMESTAMP_NTZ, end_t TIMESTAMP_NTZ", "BIGINT", f"CAST({_floored('SECOND')} AS BIGINT)"),
    "stop_seconds_truncated": ("start_t TIMESTAMP_NTZ, end_t TIMESTAMP_NTZ", "BIGINT", f"CAST({_floored('MILLISECOND')} AS BIGINT)"),
    "look_back_start": ("query_time TIMESTAMP_NTZ, look_back INT", "TIMESTAMP_NTZ", "query_time - make_dt_interval(0, 0, look_back)"),
    "minutes_stopped": ("seconds BIGINT", "DOUBLE", "round(seconds / 60.0D, 1)"),
    "kept_text": ("text STRING", "STRING", f"substring(text, 1, {TEXT_KEEP_CHARS})"),
    "without_head": ("text STRING, head INT", "STRING", "substring(text, head + 1)"),
}


def stop_ends_sql(view: str, condition: str, prefix: str = "") -> str:
    """SQL for every stop end of the readings of ``view`` that meet ``condition``, with its last moving time."""
    return f"""
WITH known AS (
  SELECT vehicle_tag, train_assignment, report_time, speed, latitude, longitude, CAST(report_time AS DATE) AS day
  FROM {view} WHERE vehicle_tag IS NOT NULL AND ({condition})),
in_day AS (
  SELECT *, lead(speed) OVER w AS near_speed, lead(true) OVER w AS has_next,
         max(CASE WHEN speed > 0 THEN report_time END) OVER (
           PARTITION BY vehicle_tag, day ORDER BY report_time
           RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS near_moving
  FROM known WINDOW w AS (PARTITION BY vehicle_tag, day ORDER BY report_time)),
days AS (
  SELECT vehicle_tag, day, min_by(speed, report_time) AS first_speed, max(CASE WHEN speed > 0 THEN report_time END) AS moving
  FROM known GROUP BY vehicle_tag, day),
carried AS (
  SELECT vehicle_tag, day, lead(first_speed) OVER (PARTITION BY vehicle_tag ORDER BY day) AS far_speed,
         max(moving) OVER (PARTITION BY vehicle_tag ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far_moving
  FROM days),
ends AS (
  SELECT *, coalesce(near_moving, far_moving) AS stopped_since FROM in_day JOIN carried USING (vehicle_tag, day)
  WHERE speed = 0 AND CASE WHEN has_next THEN near_speed ELSE far_speed END > 0)
SELECT vehicle_tag, train_assignment, report_time AS stopped_at, stopped_since,
       {prefix}TimeDiff(stopped_since, report_time) AS stopped_for, latitude, longitude
FROM ends WHERE stopped_since IS NOT NULL"""


def _tables(view: str, prefix: str) -> dict[str, tuple[str, str, str]]:
    look_back = stop_ends_sql(view, "report_time BETWEEN query_time - make_dt_interval(0, 0, look_back) AND query_time", prefix)
    one = stop_ends_sql(view, "vehicle_tag = vehicle AND report_time IS NOT NULL", prefix)
    whole = stop_ends_sql(view, "report_time IS NOT NULL", prefix)
    return {
        "list_stopped_vehicles": (
            "query_time TIMESTAMP_NTZ, look_back INT",
            "veh_tag STRING, train_asng STRING, stopped_at TIMESTAMP_NTZ, stopped_for INT, lat DOUBLE, lon DOUBLE",
            f"SELECT vehicle_tag, train_assignment, stopped_at, stopped_for, latitude, longitude FROM ({look_back})",
        ),
        "stops_of_vehicle": (
            "vehicle STRING",
            "stopped_at TIMESTAMP_NTZ, stopped_since TIMESTAMP_NTZ, stopped_for INT, latitude DOUBLE, longitude DOUBLE",
            f"SELECT stopped_at, stopped_since, stopped_for, latitude, longitude FROM ({one})",
        ),
        "stops_between": (
            "lower_t TIMESTAMP_NTZ, upper_t TIMESTAMP_NTZ",
            "vehicle_tag STRING, stopped_at TIMESTAMP_NTZ, stopped_for INT, latitude DOUBLE, longitude DOUBLE",
            f"SELECT vehicle_tag, stopped_at, stopped_for, latitude, longitude FROM ({whole}) WHERE stopped_at BETWEEN lower_t AND upper_t",
        ),
    }


def register_functions(spark: SparkSession, readings: DataFrame, view: str = "readings", prefix: str = "") -> list[str]:
    """Create the functions over ``readings`` for this session (replacing those of the same name); returns their names.

    ``readings`` becomes the temporary view ``view``. Scalar: ``TimeDiff(start_t, end_t)`` (exact seconds rounded half
    to even), ``stop_seconds`` (clock seconds), ``stop_seconds_truncated``, ``look_back_start``, ``minutes_stopped``,
    ``kept_text``, ``without_head``. Tables: ``list_stopped_vehicles(query_time, look_back)`` (readings of the look-back
    range only), ``stops_of_vehicle(vehicle)``, ``stops_between(lower_t, upper_t)`` (finished stops over the whole
    history). Rows without vehicle or time take no part; a NULL argument gives NULL or no rows.
    """
    readings.createOrReplaceTempView(view)
    made = []
    for name, (parameters, result, body) in SCALAR.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {result} RETURN {body}")
        made.append(prefix + name)
    for name, (parameters, columns, body) in _tables(view, prefix).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS TABLE ({columns}) RETURN {body}")
        made.append(prefix + name)
    return made
