"""Time arithmetic on Columns: stop lengths, hour of day, look-back start, display forms.

All functions are built-in Column expressions (no UDF), so they stay inside
whole-stage code generation. Timestamps without zone are read as wall-clock
values, independent of the session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_micros(c, dtype: T.DataType | None = None) -> Column:
    """Microseconds since 1970-01-01 of a timestamp (wall clock for timestamp_ntz)."""
    c = _col(c)
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c)
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH_NTZ), c)


def floor_div(c, n: int) -> Column:
    """Exact floor division of a long Column by a positive constant."""
    c = _col(c)
    return ((c - F.pmod(c, F.lit(n))) / F.lit(n)).cast("long")


def stop_length_seconds(end, start) -> Column:
    """Whole-second clock difference (both times floored to seconds), long."""
    return F.unix_timestamp(_col(end)) - F.unix_timestamp(_col(start))


def stop_length_trunc(end, start, dtype: T.DataType | None = None) -> Column:
    """(end ms - start ms) / 1000, truncated toward zero; long.

    Milliseconds are the floored epoch milliseconds of each time, as a Java
    ``Timestamp.getTime()`` gives them.
    """
    diff_ms = floor_div(epoch_micros(end, dtype), 1000) - floor_div(epoch_micros(start, dtype), 1000)
    # Truncation toward zero of a long division.
    return (F.signum(diff_ms) * floor_div(F.abs(diff_ms), 1000)).cast("long")


def stop_length_rounded(end, start, dtype: T.DataType | None = None) -> Column:
    """day/hour/minute/second parts of (end - start) summed, stored in an integer.

    The sum is the exact difference in seconds with its fraction; storing it in
    an integer rounds half to even.
    """
    diff_us = epoch_micros(end, dtype) - epoch_micros(start, dtype)
    return F.bround(diff_us / F.lit(1_000_000.0), 0).cast("int")


def hour_of_day(c) -> Column:
    """T4: hour 0..23 as int."""
    return F.hour(_col(c)).cast("int")


def look_back_start(query_time, minutes: int) -> Column:
    """T5: query_time minus a number of minutes."""
    qt = F.lit(query_time).cast("timestamp_ntz") if isinstance(query_time, str) else _col(query_time)
    return qt - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(int(minutes)), F.lit(0))


def minutes_stopped(seconds) -> Column:
    """Seconds shown as minutes with one decimal (half-up rounding)."""
    return F.round(_col(seconds) / F.lit(60.0), 1)


def minutes_to_seconds(minutes: int) -> int:
    """Form parameters in minutes become seconds."""
    return 60 * int(minutes)


def display_time(c) -> Column:
    """Timestamp as 'yyyy-MM-dd HH:mm:ss' text."""
    return F.date_format(_col(c), "yyyy-MM-dd HH:mm:ss")


def empty_if_null(c) -> Column:
    """NULL text shown as ''."""
    return F.coalesce(_col(c), F.lit(""))
