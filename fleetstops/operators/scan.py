"""History scan over per-vehicle time series, always split by (vehicle, calendar chunk).

For every reading it finds

* the speed of the vehicle's next reading (``lead``), and
* the latest earlier *moving* reading of the same vehicle (time and id), plus the
  largest id of any earlier moving reading,

which is all that stop detection needs. One plan serves every size:

1. readings are dealt once by (vehicle, chunk), a chunk being a fixed calendar piece (``chunk_seconds``, one day
   unless stated), so one vehicle's long history is as many pieces as it has days;
2. a window per piece answers everything that stays inside it;
3. a grouped aggregate over the same pieces (the same shuffle: Spark reuses the exchange, so the source is read
   once) gives one summary row per piece: its first speed and its last moving reading;
4. a window over the summaries, per vehicle in chunk order, carries values across borders. It holds one row per
   vehicle and day, however many readings there are;
5. the carry rows are joined back on (vehicle, chunk); the readings are already dealt by that key.

Windows are ordered by the timestamp itself (no per-row conversion); "earlier" is strict, a
``RANGE … 1 MICROSECOND PRECEDING`` frame, so readings at the same time never see each other, matching a
``report_time > moving.report_time`` join condition even when keys repeat.

Readings without a vehicle are one group of their own, and readings without a time come first in their vehicle's
order, as in a plain window; readings without a time never count as moving.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.time import floor_div
from ..tuning import CHUNK_SECONDS

# Names of the internal columns (removed from every output).
PART = "_fs_part"  # struct(vehicle, chunk): the key of the one full shuffle
MV = "_fs_moving"
NX_T = "_fs_next_t"
NX_SPEED = "_fs_next_speed"
# Chunk of readings without a time: before every calendar chunk.
NO_TIME = -(1 << 62)


def chunk_of(time, chunk_seconds: int) -> Column:
    """Number of the calendar chunk of a time, from whole epoch seconds (wall clock for ``timestamp_ntz``)."""
    return floor_div(F.unix_timestamp(time), int(chunk_seconds))


def deal(readings: DataFrame, *, key: str = "vehicle_tag", time: str = "report_time", chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """Readings dealt by (vehicle, chunk): the struct ``PART`` replaces the vehicle column."""
    chunk = F.coalesce(chunk_of(F.col(time), chunk_seconds), F.lit(NO_TIME))
    part = F.struct(F.col(key).alias("k"), chunk.alias("c")).alias(PART)
    return readings.select(part, *[F.col(c) for c in readings.columns if c != key]).repartition(F.col(PART))


def strictly_before(agg_sql: str, time: str) -> Column:
    """``agg_sql`` over the rows of the same piece strictly earlier in time."""
    return F.expr(
        f"{agg_sql} OVER (PARTITION BY `{PART}` ORDER BY `{time}` "
        f"RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING)"
    )


def history_scan(
    readings: DataFrame,
    *,
    key: str = "vehicle_tag",
    time: str = "report_time",
    speed: str | None = "speed",
    rid: str = "reading_id",
    moving: Column | None = None,
    keep: Column | None = None,
    with_next: bool = True,
    with_last: bool = True,
    chunk_seconds: int = CHUNK_SECONDS,
    dealt: DataFrame | None = None,
) -> DataFrame:
    """Add ``next_speed``, ``last_moving_time``, ``last_moving_id``, ``max_moving_id``.

    ``moving`` marks the readings that count as moving (default ``speed > 0``).
    ``keep`` is a filter applied after the in-piece window and before the carry
    join; it may use the input columns and ``NX_T``/``NX_SPEED`` (the in-piece
    next reading, NULL time when the reading is last in its piece).
    ``dealt``: ``readings`` as :func:`deal` gives them, where the caller uses that shuffle again.
    """
    if moving is None:
        moving = F.col(speed) > 0
    out_cols = list(readings.columns)
    if dealt is None:
        dealt = deal(readings, key=key, time=time, chunk_seconds=chunk_seconds)
    marked = dealt.withColumn(MV, F.coalesce(moving & F.col(time).isNotNull(), F.lit(False)))

    # Inside each piece.
    w = Window.partitionBy(PART).orderBy(time)
    extra = []
    if with_next:
        extra += [F.lead(time).over(w).alias(NX_T), F.lead(speed).over(w).alias(NX_SPEED), F.lead(F.lit(True)).over(w).alias("_fs_has_next")]
    if with_last:
        extra += [
            strictly_before(f"max(CASE WHEN `{MV}` THEN named_struct('t', `{time}`, 'id', `{rid}`) END)", time).alias("_fs_lm"),
            strictly_before(f"max(CASE WHEN `{MV}` THEN `{rid}` END)", time).alias("_fs_mmid"),
        ]
    scanned = marked.select("*", *extra)
    if keep is not None:
        scanned = scanned.filter(keep)

    # One summary row per piece, from the same shuffle. Both uses of it must need the same columns for Spark to
    # reuse it: the columns that a summary doesn't need otherwise go into a hash that the filter below looks at.
    aggs, used = [], {time}
    mv_t = F.when(F.col(MV), F.col(time))
    if with_next:
        aggs.append(F.min_by(F.col(speed), F.coalesce(F.col(time), F.lit("0001-01-01").cast("timestamp_ntz"))).alias("_fs_first_speed"))
        used.add(speed)
    if with_last:
        aggs += [
            F.max(mv_t).alias("_fs_c_t"),
            F.max_by(F.when(F.col(MV), F.col(rid)), mv_t).alias("_fs_c_id"),
            F.max(F.when(F.col(MV), F.col(rid))).alias("_fs_c_mmid"),
        ]
        used.add(rid)
    rest = [F.col(c) for c in out_cols if c != key and c not in used]
    summary = marked.groupBy(PART).agg(*aggs, F.max(F.hash(*rest) if rest else F.lit(0)).alias("_fs_same"))
    summary = summary.filter(F.col("_fs_same").isNotNull())

    # Carry across chunks, per vehicle in chunk order.
    wk = Window.partitionBy(F.col(f"{PART}.k")).orderBy(F.col(f"{PART}.c"))
    prior = wk.rowsBetween(Window.unboundedPreceding, -1)
    carry_cols = [F.col(PART)]
    if with_next:
        carry_cols.append(F.lead("_fs_first_speed").over(wk).alias("_fs_cx_speed"))
    if with_last:
        c_row = F.when(F.col("_fs_c_t").isNotNull(), F.struct(F.col("_fs_c_t").alias("t"), F.col("_fs_c_id").alias("id")))
        carry_cols += [F.last(c_row, ignorenulls=True).over(prior).alias("_fs_cl"), F.max("_fs_c_mmid").over(prior).alias("_fs_cmmid")]
    joined = scanned.join(summary.select(*carry_cols), PART, "inner")

    result = [F.col(f"{PART}.k").alias(key) if c == key else F.col(c) for c in out_cols]
    if with_next:
        result.append(F.when(F.col("_fs_has_next"), F.col(NX_SPEED)).otherwise(F.col("_fs_cx_speed")).alias("next_speed"))
    if with_last:
        lm = F.coalesce(F.col("_fs_lm"), F.col("_fs_cl"))
        result += [
            lm["t"].alias("last_moving_time"),
            lm["id"].alias("last_moving_id"),
            F.greatest(F.col("_fs_mmid"), F.col("_fs_cmmid")).alias("max_moving_id"),
        ]
    return joined.select(*result)


def stop_end_candidates(speed: str = "speed") -> Column:
    """``keep`` filter for stop ends: stopped now, and not followed inside the piece by a non-moving reading."""
    return (F.col(speed) == 0) & (F.col(NX_T).isNull() | (F.col(NX_SPEED) > 0))
