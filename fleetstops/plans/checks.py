"""Argument checks of the report questions (the web form checks, re-aimed at the library).

Each question checks its own arguments before building a plan and raises
``ValueError`` with the reason. The form's page-specific limits (a look-back of
at most 120 minutes, dates within the years the site had data for) are not
imposed: they belong to the page, not to the question.
"""

from __future__ import annotations

import datetime as dt


def _int(value, what: str) -> int:
    if isinstance(value, bool):
        raise ValueError(f"{what} must be an integer")
    try:
        whole = int(value)
    except (TypeError, ValueError):
        raise ValueError(f"{what} must be an integer") from None
    if not isinstance(value, str) and whole != value:
        raise ValueError(f"{what} must be an integer")
    return whole


def check_query_time(query_time) -> str:
    """A 'YYYY-MM-DD hh:mm:ss' text naming an existing time, or a datetime, which keeps its parts of a second."""
    if isinstance(query_time, dt.datetime):
        return query_time.replace(tzinfo=None).isoformat(sep=" ")
    try:
        return dt.datetime.strptime(query_time, "%Y-%m-%d %H:%M:%S").isoformat(sep=" ")
    except (TypeError, ValueError):
        raise ValueError("query time must be an existing time in the format YYYY-MM-DD hh:mm:ss") from None


def check_look_back(look_back) -> int:
    """Look-back window in whole minutes, at least 1."""
    minutes = _int(look_back, "look-back window")
    if minutes < 1:
        raise ValueError("look-back window must be at least 1 minute")
    return minutes


def check_hour(hour) -> int:
    """Hour of day 0..23."""
    h = _int(hour, "hour of day")
    if not 0 <= h <= 23:
        raise ValueError("hour of day must be between 0 and 23")
    return h


def check_stop_bound(value, what: str) -> int:
    """A stop-length bound in whole minutes, not negative (0 = no bound)."""
    v = _int(value, what)
    if v < 0:
        raise ValueError(f"{what} must not be negative")
    return v


def check_limit(limit) -> int:
    """Row limit, not negative (0 = all rows)."""
    k = _int(limit, "row limit")
    if k < 0:
        raise ValueError("row limit must not be negative (0 means all rows)")
    return k
