"""Stop detection: next speed, stop ends, last moving time, stop length, long stops.

All of them run on :func:`fleetstops.operators.scan.history_scan`, one shuffle
by (vehicle, calendar chunk), instead of the per-vehicle range join
``stopped ⋈ moving ON same vehicle AND earlier`` (which meets every stop end
with every earlier moving reading of its vehicle).

Exactness of the window form against the join form:

* without an id bound (``max_id_gap=None``) the latest earlier moving reading is
  the join's ``max(moving.report_time)``; always exact.
* with an id bound the latest earlier moving reading m* decides when it passes
  the bound, and when *no* earlier moving reading has an id inside the bound
  (``max_moving_id`` check) the stop has no match; both are exact. Only when
  ids of a vehicle fall while time rises can m* fail while an older reading
  passes. Such open rows meet the moving readings of their own chunk and of one
  earlier chunk, which come from the scan's own shuffle
  (:mod:`fleetstops.operators.gap_resolve`). That is part of the plan and starts no job:
  where ids follow time, the open side is empty, which Spark finds at run time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import LONG_STOP_MAX_S, LONG_STOP_MIN_S, MAX_ID_GAP
from ..functions.time import stop_length_seconds
from ..tuning import CHUNK_SECONDS
from .gap_resolve import resolve_in_chunks, resolve_undecided
from .scan import deal, history_scan, stop_end_candidates


def next_speed(
    readings: DataFrame,
    *,
    key: str = "vehicle_tag",
    time: str = "report_time",
    speed: str = "speed",
    rid: str = "reading_id",
    chunk_seconds: int = CHUNK_SECONDS,
) -> DataFrame:
    """Every reading with the speed of the vehicle's next reading (NULL for the last one)."""
    return history_scan(
        readings, key=key, time=time, speed=speed, rid=rid, with_last=False, chunk_seconds=chunk_seconds
    )


def find_last_stopped(
    readings: DataFrame,
    *,
    key: str = "vehicle_tag",
    time: str = "report_time",
    speed: str = "speed",
    rid: str = "reading_id",
    chunk_seconds: int = CHUNK_SECONDS,
) -> DataFrame:
    """readings that end a stop: speed = 0 and the next reading's speed > 0."""
    scanned = history_scan(
        readings,
        key=key,
        time=time,
        speed=speed,
        rid=rid,
        with_last=False,
        keep=stop_end_candidates(speed),
        chunk_seconds=chunk_seconds,
    )
    return scanned.filter((F.col(speed) == 0) & (F.col("next_speed") > 0))


def filter_moving(readings: DataFrame, speed: str = "speed") -> DataFrame:
    """moving readings (speed > 0)."""
    return readings.filter(F.col(speed) > 0)


def filter_stopped(readings: DataFrame, speed: str = "speed") -> DataFrame:
    """readings with speed = 0."""
    return readings.filter(F.col(speed) == 0)


def last_moving_window(
    readings: DataFrame,
    *,
    key: str = "vehicle_tag",
    time: str = "report_time",
    speed: str = "speed",
    rid: str = "reading_id",
    chunk_seconds: int = CHUNK_SECONDS,
) -> DataFrame:
    """For every speed-0 reading, the latest earlier moving time of its vehicle (NULL if none)."""
    scanned = history_scan(
        readings,
        key=key,
        time=time,
        speed=speed,
        rid=rid,
        with_next=False,
        keep=F.col(speed) == 0,
        chunk_seconds=chunk_seconds,
    )
    return scanned.select(rid, key, time, "last_moving_time")


def _gap_ok(rid: str, max_id_gap: int | None):
    if max_id_gap is None:
        return F.col("last_moving_time").isNotNull()
    return F.col("last_moving_time").isNotNull() & ((F.col(rid) - F.col("last_moving_id")) < F.lit(max_id_gap))


def _ambiguous(rid: str, max_id_gap: int | None):
    if max_id_gap is None:
        return F.lit(False)
    return ~F.coalesce(_gap_ok(rid, max_id_gap), F.lit(False)) & F.coalesce(
        (F.col(rid) - F.col("max_moving_id")) < F.lit(max_id_gap), F.lit(False)
    )


def _answered(flagged: DataFrame, resolve, *, key: str, time: str, rid: str) -> DataFrame:
    """One row per (vehicle, time) of ``flagged`` stops that has a last moving time, the latest.

    ``flagged`` holds decided rows and, marked ``_fs_amb``, open ones, which ``resolve(rows)`` answers with rows
    (key, time, found). The columns come from the stop's reading (the largest by all columns where several share
    vehicle and time).
    """
    others = [c for c in flagged.columns if c not in (key, time, "_fs_amb", "last_moving_time", "last_moving_id", "max_moving_id")]
    amb = F.col("_fs_amb")
    decided = F.max(F.when(~amb, F.struct(F.col("last_moving_time").alias("lm"), *others))).alias("_fs_d")
    is_open = F.min(F.when(amb, F.struct(F.col(rid).alias("low"), *others))).alias("_fs_o")
    per = flagged.groupBy(key, time).agg(decided, is_open)
    # Open groups look at both aggregates (the second condition always holds), so that the groups are made once.
    o = per.filter(F.col("_fs_o").isNotNull() & (F.col("_fs_d").isNull() | F.col("_fs_d.lm").isNotNull()))
    found = resolve(o.select(key, time, F.col("_fs_o.low").alias(rid)))
    best = per.join(found, [key, time], "left")
    from_open = F.when(F.col("found").isNotNull(), F.struct(F.col("found").alias("lm"), *[F.col(f"_fs_o.{c}") for c in others]))
    best = best.select(key, time, F.greatest(F.col("_fs_d"), from_open).alias("r")).filter(F.col("r").isNotNull())
    return best.select(key, time, *[F.col(f"r.{c}") for c in others], F.col("r.lm").alias("last_moving_time"))


def last_moving_time(
    stopped: DataFrame,
    moving: DataFrame,
    *,
    max_id_gap: int | None = MAX_ID_GAP,
    key: str = "vehicle_tag",
    time: str = "report_time",
    rid: str = "reading_id",
    chunk_seconds: int = CHUNK_SECONDS,
) -> DataFrame:
    """For each stopped reading, the latest earlier moving time of the same vehicle.

    Inner semantics: stopped readings without such a moving reading, or without
    vehicle or time, are left out. With ``max_id_gap`` only moving readings whose
    id is less than that far below the stopped reading's id count. One row per
    (vehicle, time).
    """
    known = F.col(key).isNotNull() & F.col(time).isNotNull()
    q = stopped.filter(known).select(F.col(key), F.col(time), F.col(rid), F.lit(False).alias("_fs_is_mv"))
    m = moving.filter(known).select(F.col(key), F.col(time), F.col(rid), F.lit(True).alias("_fs_is_mv"))
    both = q.unionByName(m)
    dealt = deal(both, key=key, time=time, chunk_seconds=chunk_seconds)
    scanned = history_scan(
        both,
        dealt=dealt,
        key=key,
        time=time,
        speed=None,
        rid=rid,
        moving=F.col("_fs_is_mv"),
        keep=~F.col("_fs_is_mv"),
        with_next=False,
        chunk_seconds=chunk_seconds,
    ).drop("_fs_is_mv")
    if max_id_gap is None:
        matched = scanned.filter(_gap_ok(rid, None))
        return matched.groupBy(key, time).agg(F.max("last_moving_time").alias("last_moving_time"))
    amb = _ambiguous(rid, max_id_gap)
    flagged = scanned.filter(_gap_ok(rid, max_id_gap) | amb).withColumn("_fs_amb", amb)

    def resolve(rows):
        return resolve_undecided(rows, dealt, max_id_gap, counts=F.col("_fs_is_mv"), key=key, time=time, rid=rid, chunk_seconds=chunk_seconds)

    return _answered(flagged, resolve, key=key, time=time, rid=rid).select(key, time, "last_moving_time")


def last_moving_time_unbounded(stopped: DataFrame, moving: DataFrame, **kw) -> DataFrame:
    """:func:`last_moving_time` without the id bound."""
    return last_moving_time(stopped, moving, max_id_gap=None, **kw)


def stop_ends_with_last_moving(
    readings: DataFrame,
    *,
    max_id_gap: int | None = MAX_ID_GAP,
    max_s: int | None = None,
    key: str = "vehicle_tag",
    time: str = "report_time",
    speed: str = "speed",
    rid: str = "reading_id",
    chunk_seconds: int = CHUNK_SECONDS,
    with_ambiguous: bool = False,
) -> DataFrame:
    """F3 + J1 in one scan: stop-end readings (all columns) with ``next_speed`` and ``last_moving_time``.

    Stop ends without a qualifying earlier moving reading, or without vehicle or
    time, are left out (inner join semantics). Without an id bound there is one row per
    stop-end reading; with one, one row per (vehicle, time). ``max_s``: the caller
    drops stops of that many seconds or more, so an id-bounded answer that old need not be found.
    With ``with_ambiguous`` open rows are returned as the window form leaves them, flagged in column ``ambiguous``.
    """
    readings = readings.filter(F.col(key).isNotNull() & F.col(time).isNotNull())
    dealt = deal(readings, key=key, time=time, chunk_seconds=chunk_seconds)
    scanned = history_scan(
        readings,
        key=key,
        time=time,
        speed=speed,
        rid=rid,
        keep=stop_end_candidates(speed),
        chunk_seconds=chunk_seconds,
        dealt=dealt,
    )
    ends = scanned.filter((F.col(speed) == 0) & (F.col("next_speed") > 0))
    ok, amb = _gap_ok(rid, max_id_gap), _ambiguous(rid, max_id_gap)
    if with_ambiguous:
        return ends.filter(ok | amb).withColumn("ambiguous", amb)
    if max_id_gap is None:
        return ends.filter(ok).drop("last_moving_id", "max_moving_id")
    flagged = ends.filter(ok | amb).withColumn("_fs_amb", amb)

    def resolve(rows):
        how = {"counts": F.col(speed) > 0, "key": key, "time": time, "rid": rid, "chunk_seconds": chunk_seconds}
        if max_s is not None:
            return resolve_in_chunks(rows, dealt, max_id_gap, max_s, **how)
        return resolve_undecided(rows, dealt, max_id_gap, **how)

    return _answered(flagged, resolve, key=key, time=time, rid=rid)


def calculate_stop_length(df: DataFrame, end: str = "report_time", start: str = "last_moving_time") -> DataFrame:
    """T1 as a column ``stopped_for`` (long seconds)."""
    return df.withColumn("stopped_for", stop_length_seconds(end, start))


def long_stops(df: DataFrame, min_s: int = LONG_STOP_MIN_S, max_s: int = LONG_STOP_MAX_S) -> DataFrame:
    """report_time, vehicle_tag, stopped_for of stops strictly between ``min_s`` and ``max_s`` seconds."""
    return df.select("report_time", "vehicle_tag", "stopped_for").filter(
        (F.col("stopped_for") > F.lit(int(min_s))) & (F.col("stopped_for") < F.lit(int(max_s)))
    )
