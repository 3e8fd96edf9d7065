"""Table sinks: create-as-select, append, distinct lists, views, SQL text."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def create_table_as(
    df: DataFrame, path: str, partition_by=None, sort_within=None, fmt: str = "parquet", cluster_by=None
) -> None:
    """Write a result as a new table (overwrite).

    ``partition_by`` gives directory partitions that filters prune (the reference
    indexes hour and length); ``sort_within`` sorts rows inside each file so that
    Parquet min/max statistics skip row groups for range filters; ``cluster_by``
    (H1) range-partitions rows by those columns before the write so each file
    holds a narrow key range (e.g. vehicle), which later per-vehicle filters skip by.
    """
    def cols(x):
        return [] if not x else ([x] if isinstance(x, str) else list(x))

    out = df
    layout = cols(partition_by) + cols(cluster_by) + cols(sort_within)
    if partition_by or cluster_by:
        # Range partitioning on (partition columns, then clustering/sort columns): a
        # large partition value (a busy hour) is split over several tasks by the
        # following columns instead of landing in one task, and each file still
        # covers one narrow key range.
        out = out.repartitionByRange(*layout)
    if sort_within:
        out = out.sortWithinPartitions(*cols(partition_by), *cols(sort_within))
    w = out.write.mode("overwrite").format(fmt)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.save(path)


def append_select(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """INSERT … SELECT — append typed rows to an existing table."""
    df.write.mode("append").format(fmt).save(path)


def refresh_distinct(source: DataFrame, column: str, path: str) -> DataFrame:
    """(re)build a distinct-value table such as vehicles or train assignments."""
    d = source.select(column).distinct()
    d.write.mode("overwrite").parquet(path)
    return source.sparkSession.read.parquet(path)


def register_view(df: DataFrame, name: str) -> DataFrame:
    """A named intermediate result usable from SQL text."""
    df.createOrReplaceTempView(name)
    return df


def run_sql(spark: SparkSession, text: str) -> DataFrame:
    """SQL text (CTEs, derived tables) over registered views; same optimizer as the DataFrame API."""
    return spark.sql(text)


def persist(df: DataFrame, disk_only: bool = False) -> DataFrame:
    """H2: optional persist; lost blocks are recomputed from lineage if an executor goes away."""
    return df.persist(StorageLevel.DISK_ONLY if disk_only else StorageLevel.MEMORY_AND_DISK)


def write_stops_detail(detail: DataFrame, path: str) -> None:
    """H3: detail table partitioned by hour, sorted by length and time inside each hour."""
    create_table_as(detail, path, partition_by="hour_of_day", sort_within=["stopped_for", "report_time"])


#: Column of the readings layout: the time in microseconds, its clock read as UTC.
TIME_MICROS = "_fs_time_micros"


def write_readings(readings: DataFrame, path: str, files: int | None = None, bits: int = 12) -> None:
    """H3: readings table that answers both a time range and a vehicle by skipping, in place of its time and vehicle indexes.

    Rows are ordered by the interleaved bits of their time (a linear scale between the first and the last) and of a hash of
    their vehicle, so a file holds a narrow time range of few vehicles: Parquet's min/max skip by time, Bloom filters by
    vehicle, which pushed equality filters ask. Spark pushes no range of ``timestamp_ntz`` into Parquet, so the time is
    stored as a long beside (TIME_MICROS), which :func:`read_readings` filters by. Hot cells are split by time and id. ``files``: how many (None: Spark's
    shuffle partitions). Rows without a time come first, those without a vehicle share one hash.
    """
    first, last = readings.agg(F.min("report_time"), F.max("report_time")).first()
    at = _micros
    lower, upper = (at(F.lit(x).cast("timestamp_ntz")) for x in (first, last))
    share = (at(F.col("report_time")) - lower) / F.nullif(upper - lower, F.lit(0))
    when = F.coalesce((share * F.lit((1 << bits) - 1)).cast("long"), F.lit(0).cast("long"))
    who = F.pmod(F.xxhash64("vehicle_tag"), F.lit(1 << bits))
    cell = sum(
        (F.shiftleft(F.shiftright(c, i).bitwiseAND(F.lit(1).cast("long")), 2 * i + k) for i in range(bits) for k, c in ((0, who), (1, when))),
        F.lit(0).cast("long"),
    )
    order = ["_fs_cell", "report_time", "reading_id"]
    tagged = readings.withColumns({"_fs_cell": cell, TIME_MICROS: at(F.col("report_time"))})
    dealt = tagged.repartitionByRange(files, *order) if files else tagged.repartitionByRange(*order)
    out = dealt.sortWithinPartitions(*order).drop("_fs_cell")
    out.write.mode("overwrite").option("parquet.bloom.filter.enabled#vehicle_tag", "true").parquet(path)


def _micros(time) -> Column:
    """Microseconds of a ``timestamp_ntz``, whatever the session's time zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), time)


def read_readings(spark: SparkSession, path: str, lower: str | None = None, upper: str | None = None) -> DataFrame:
    """A table of :func:`write_readings`, its readings from ``lower`` on and before ``upper`` (None: open, then rows without
    a time stay, if both are)."""
    out = spark.read.parquet(path)
    for bound, keep in ((lower, Column.__ge__), (upper, Column.__lt__)):
        if bound is not None:
            out = out.filter(keep(F.col(TIME_MICROS), _micros(F.lit(bound).cast("timestamp_ntz"))))
    return out.drop(TIME_MICROS)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A table written by :func:`create_table_as` (Parquet by default)."""
    return spark.read.format(fmt).load(path)


def hour_partition_filter(df: DataFrame, hour: int) -> DataFrame:
    """Filter on the partition column: only that hour's folder is listed and read."""
    return df.filter(F.col("hour_of_day") == F.lit(int(hour)))
