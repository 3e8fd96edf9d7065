"""Column functions that clean and type raw position text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import RAW_HEADER, RAW_TIME_FORMAT, TEXT_KEEP_CHARS


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_header(c, header: str = RAW_HEADER) -> Column:
    """Cut the glued file header wherever it appears in a line; the data after it stays.

    A literal replace (the header holds no pattern characters), half the cost of a regex replace.
    """
    return F.replace(_col(c), F.lit(header), F.lit(""))


# Raw time text, one- or two-digit fields allowed (as the database's to_timestamp accepts).
_RAW_TIME_RX = r"^\s*(\d{1,2})/(\d{1,2})/(\d{4}) (\d{1,2}):(\d{1,2}):(\d{1,2})\s*$"
_GAP_FREE_ZONES = {"UTC", "GMT", "Z", "Etc/UTC", "Etc/GMT", "UCT", "Universal", "Zulu"}


def _session_zone_has_gaps() -> bool:
    """Whether the session time zone can skip local times (daylight saving); fixed offsets cannot."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    tz = spark.conf.get("spark.sql.session.timeZone") if spark is not None else "UTC"
    return not (tz in _GAP_FREE_ZONES or re.fullmatch(r"(UTC|GMT)?[+-]\d{1,2}(:?\d{2})?", tz) is not None)


def parse_report_time(c, fmt: str = RAW_TIME_FORMAT) -> Column:
    """P5: 'MM/dd/yyyy HH:mm:ss' text to timestamp_ntz; unparsable text gives NULL.

    The fast built-in parser
    decides every row it parses when the session time zone has no local-time
    gaps (UTC and fixed offsets, the usual cluster setting). Otherwise a row
    whose parse does not print back to its own text (a wall-clock time inside a
    daylight-saving gap) is rebuilt too. Rebuilding takes the fields in ISO order
    (one-digit fields allowed) and casts to timestamp_ntz; only rows that need it
    evaluate that branch.
    """
    c = _col(c)
    fast = F.try_to_timestamp(c, F.lit(fmt)).cast("timestamp_ntz")
    if fmt != RAW_TIME_FORMAT:
        return fast
    exact = F.when(c.rlike(_RAW_TIME_RX), F.regexp_replace(c, _RAW_TIME_RX, "$3-$1-$2 $4:$5:$6").try_cast("timestamp_ntz"))
    if not _session_zone_has_gaps():
        return F.coalesce(fast, exact)  # the exact branch runs only where the fast parse failed
    return F.when(fast.isNotNull() & (F.date_format(fast, fmt) == c), fast).otherwise(exact)


def parse_report_time_strict(c, fmt: str = RAW_TIME_FORMAT) -> Column:
    """P5 as the original database conversion: NULL stays NULL, malformed text raises."""
    c = _col(c)
    wrong = F.raise_error(F.concat(F.lit("malformed report time: "), c)).cast("timestamp_ntz")
    return F.coalesce(parse_report_time(c, fmt), F.when(c.isNotNull(), wrong))


def empty_to_null_double(c) -> Column:
    """P6: '' becomes NULL, other text is cast to double (malformed text raises under ANSI)."""
    c = _col(c)
    return F.when(c != F.lit(""), c.cast("double"))


def empty_to_null_double_lenient(c) -> Column:
    """P6, lenient mode: '' and malformed text both become NULL."""
    c = _col(c)
    return F.when(c != F.lit(""), c.try_cast("double"))


def truncate_text(c, keep: int = TEXT_KEEP_CHARS) -> Column:
    """Keep the first ``keep`` characters."""
    return F.substring(_col(c), 1, keep)


def make_point(lat, lon) -> Column:
    """P10: a (lat, lon) point from two text values."""
    return F.struct(_col(lat).cast("double").alias("lat"), _col(lon).cast("double").alias("lon"))


def substring_tail(c, skip: int) -> Column:
    """The text after a fixed-length prefix of ``skip`` characters."""
    return F.substring(_col(c), skip + 1, 2147483647)


def drop_last_char(c) -> Column:
    """The text without its last character (``substring(c, 1, length(c) - 1)``)."""
    c = _col(c)
    return F.substring(c, F.lit(1), F.length(c) - F.lit(1))
