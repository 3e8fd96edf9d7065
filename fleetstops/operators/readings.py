"""Operators over the typed readings table: filters, dedupe, checks and simple aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tuning import CHUNK_SECONDS
from .scan import PART, deal


def between_times(df: DataFrame, lo, hi, time: str = "report_time") -> DataFrame:
    """inclusive time range (a bound given as None is open); the filter reaches the Parquet scan."""

    def lit(v):
        return F.lit(v).cast("timestamp_ntz") if isinstance(v, str) else F.lit(v)

    if lo is None and hi is None:
        return df
    if lo is None:
        return df.filter(F.col(time) <= lit(hi))
    if hi is None:
        return df.filter(F.col(time) >= lit(lo))
    return df.filter(F.col(time).between(lit(lo), lit(hi)))


def for_vehicle(df: DataFrame, tag: str, key: str = "vehicle_tag") -> DataFrame:
    """one vehicle."""
    return df.filter(F.col(key) == F.lit(tag))


def dedupe_readings(
    readings: DataFrame, keys=("vehicle_tag", "report_time"), rid: str = "reading_id"
) -> DataFrame:
    """Keep, for each key, only the reading with the largest id (of equal ids the largest by the other columns).

    One shuffle by key. The largest reading of a key is taken inside each task before it, so a key with very many copies
    sends one row a task; the price is a sort in the task, as rows are wider than a hash aggregate's buffer takes.
    """
    keys = list(keys)
    others = [c for c in readings.columns if c not in keys and c != rid]
    # Keys with a NULL part never equal another key (the original deletes duplicates
    # with an equality self-join), so such rows each get a group of their own.
    any_null = F.lit(False)
    for k in keys:
        any_null = any_null | F.col(k).isNull()
    tagged = readings.withColumn("_fs_solo", F.when(any_null, F.monotonically_increasing_id()))
    best = tagged.groupBy(*keys, "_fs_solo").agg(F.max(F.struct(rid, *others)).alias("_fs_best"))
    return best.select(*[F.col(c) if c in keys else F.col("_fs_best")[c].alias(c) for c in readings.columns])


def duplicate_keys(readings: DataFrame, keys=("vehicle_tag", "report_time")) -> DataFrame:
    """A2: keys that occur more than once, with their count."""
    return readings.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def speed_bounds(readings: DataFrame, speed: str = "speed") -> DataFrame:
    """A3: global minimum and maximum speed."""
    return readings.agg(F.min(speed).alias("min_speed"), F.max(speed).alias("max_speed"))


def coordinate_bounds(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """A4: global bounds of the coordinates (cast to double first, never compared as text)."""
    la, lo = F.col(lat).cast("double"), F.col(lon).cast("double")
    return df.agg(
        F.min(la).alias("min_lat"), F.max(la).alias("max_lat"), F.min(lo).alias("min_lon"), F.max(lo).alias("max_lon")
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """The distinct values of one column."""
    return df.select(column).distinct()


def distinct_vehicles(readings: DataFrame) -> DataFrame:
    """The distinct vehicle tags."""
    return distinct_values(readings, "vehicle_tag")


def distinct_assignments(readings: DataFrame) -> DataFrame:
    """The distinct train assignments."""
    return distinct_values(readings, "train_assignment")


def row_count(df: DataFrame) -> DataFrame:
    """count(*) as a one-row DataFrame."""
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def ids_follow_time(
    readings: DataFrame,
    *,
    key: str = "vehicle_tag",
    time: str = "report_time",
    rid: str = "reading_id",
    chunk_seconds: int = CHUNK_SECONDS,
) -> DataFrame:
    """Check the condition under which the id-bounded window form can never be ambiguous.

    Returns one row: ``violations`` = readings whose id is not larger than the id
    of an earlier reading of the same vehicle; ``tied_times`` = (vehicle, time) pairs
    that several readings share (they are ordered by id above, which hides them; dedupe
    first when there are any). Uses the stop scan's split: an in-chunk running maximum plus
    the maximum carried from earlier chunks, from one shuffle of the readings.
    """
    known = readings.filter(F.col(key).isNotNull() & F.col(time).isNotNull()).select(key, time, rid)
    dealt = deal(known, key=key, time=time, chunk_seconds=chunk_seconds)
    w = Window.partitionBy(PART).orderBy(time, rid)
    second = (F.lag(time, 1).over(w) == F.col(time)) & ~F.coalesce(F.lag(time, 2).over(w) == F.col(time), F.lit(False))
    in_chunk = dealt.select(PART, rid, F.max(rid).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("_fs_prev_max"), second.alias("_fs_tie"))
    # Time takes part in the summary, so that both uses of the shuffle need the same columns and Spark makes it once.
    summary = dealt.groupBy(PART).agg(F.max(rid).alias("_fs_c_max"), F.max(time).alias("_fs_c_t")).filter(F.col("_fs_c_t").isNotNull())
    wk = Window.partitionBy(F.col(f"{PART}.k")).orderBy(F.col(f"{PART}.c")).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(PART, F.max("_fs_c_max").over(wk).alias("_fs_carry_max"))
    joined = in_chunk.join(carry, PART)
    return joined.agg(
        F.count_if(F.col(rid) <= F.greatest("_fs_prev_max", "_fs_carry_max")).alias("violations"),
        F.count_if("_fs_tie").alias("tied_times"),
    )


__all__ = [
    "between_times",
    "for_vehicle",
    "dedupe_readings",
    "duplicate_keys",
    "speed_bounds",
    "coordinate_bounds",
    "distinct_values",
    "distinct_vehicles",
    "distinct_assignments",
    "row_count",
    "ids_follow_time",
]
