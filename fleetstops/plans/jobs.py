"""Batch jobs: ``spark-submit run_job.py <job> ...`` (or call the functions from Python).

* ``fleet``: readings (Parquet path or JDBC table) → long stops between two
  times → Parquet table or JDBC table (overwrite). The only action is the write.
* ``ingest``: raw daily files (glob) → typed, deduplicated readings (Parquet)
  plus a per-file manifest.
* ``stop-times``: readings → every stop end with the last moving time (table).
* ``detail``: readings → long stops with hour and coordinates, written as a
  table partitioned by hour and sorted by stop length (for the history pages).
* ``daily``: the readings of one batch (from a time, up to another) → the stop tables that are kept batch by batch.
* ``upsert``: a batch of readings → the readings table without duplicates, and its counted distinct lists.
* ``reference``: transit stops and trips from CSV into their two tables.

Sources and sinks are given as ``parquet:<path>`` or ``jdbc:<table>`` (the JDBC
URL and driver come from ``--jdbc-url`` / ``--jdbc-driver``).
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import DEFAULT_LOWER_BOUND, DEFAULT_UPPER_BOUND
from ..operators.readings import between_times, dedupe_readings
from ..sources.jdbc import read_jdbc_partitioned, write_jdbc
from ..sources.tables import create_table_as, write_stops_detail
from .daily import add_batch
from .fleet import stop_times, stopped_vehicles, stops_detail
from .ingestion import ingest_files_with_log, load_reference_tables
from .upsert import refresh_values, upsert_batch


def _read(spark: SparkSession, source: str, lower: str, upper: str, jdbc: dict, partitions: int) -> DataFrame:
    kind, _, where = source.partition(":")
    if kind == "parquet":
        return spark.read.parquet(where)
    if kind == "jdbc":
        # Parallel range read on the report time (the bounds set the stride; the
        # time filter of the job is applied on top and pushed into the database).
        return read_jdbc_partitioned(
            spark, jdbc["url"], where, "report_time", lower, upper, partitions, {"driver": jdbc["driver"]}
        )
    raise ValueError(f"unknown source {source!r}")


def _write(df: DataFrame, sink: str, jdbc: dict, partitions: int) -> None:
    kind, _, where = sink.partition(":")
    if kind == "parquet":
        create_table_as(df, where)
    elif kind == "jdbc":
        # At most so many connections to the database at once.
        write_jdbc(df, jdbc["url"], where, "overwrite", {"driver": jdbc["driver"]}, num_partitions=partitions)
    else:
        raise ValueError(f"unknown sink {sink!r}")


def run_fleet_job(
    spark: SparkSession,
    source: str,
    sink: str,
    lower: str = DEFAULT_LOWER_BOUND,
    upper: str = DEFAULT_UPPER_BOUND,
    jdbc: dict | None = None,
    partitions: int = 8,
) -> None:
    """Fleet stops between ``lower`` and ``upper`` from ``source`` written to ``sink``."""
    jdbc = jdbc or {}
    readings = _read(spark, source, lower, upper, jdbc, partitions)
    _write(stopped_vehicles(readings, lower, upper), sink, jdbc, partitions)


def run_ingest_job(spark: SparkSession, raw_glob: str, readings_path: str, manifest_path: str, lenient: bool = False) -> None:
    """Raw daily files → readings (deduplicated) and a per-file manifest.

    The typed rows before dedupe stay beside the result as ``<readings_path>_staged``, the table the manifest counts.
    """
    staged = readings_path.rstrip("/") + "_staged"
    ingest_files_with_log(spark, raw_glob, staged, manifest_path, lenient=lenient)
    create_table_as(dedupe_readings(spark.read.parquet(staged).drop("file_name")), readings_path)


def run_stop_times_job(
    spark: SparkSession,
    source: str,
    sink: str,
    jdbc: dict | None = None,
    lower: str = DEFAULT_LOWER_BOUND,
    upper: str = DEFAULT_UPPER_BOUND,
    partitions: int = 8,
) -> None:
    """Stop times of all vehicles (no time filter) from ``source`` to ``sink``.

    ``lower`` and ``upper`` only set the stride of a JDBC read: give the times the table really spans.
    """
    jdbc = jdbc or {}
    _write(stop_times(_read(spark, source, lower, upper, jdbc, partitions)), sink, jdbc, partitions)


def run_detail_job(
    spark: SparkSession, source: str, path: str, lower=None, upper=None, jdbc: dict | None = None, partitions: int = 8
) -> None:
    """Long stops with hour and coordinates as an hour-partitioned Parquet table."""
    readings = _read(spark, source, lower or DEFAULT_LOWER_BOUND, upper or DEFAULT_UPPER_BOUND, jdbc or {}, partitions)
    write_stops_detail(stops_detail(readings, lower, upper), path)


def run_daily_job(
    spark: SparkSession, source: str, root: str, batch: str, after: str | None = None, lower=None, upper=None, jdbc: dict | None = None, partitions: int = 8
) -> None:
    """The readings from ``lower`` (inclusive) up to ``upper`` (exclusive) added to the stop tables below ``root`` as ``batch``."""
    readings = _read(spark, source, lower or DEFAULT_LOWER_BOUND, upper or DEFAULT_UPPER_BOUND, jdbc or {}, partitions)
    part = between_times(readings, lower, None)
    if upper is not None:
        part = part.filter(F.col("report_time") < F.lit(upper).cast("timestamp_ntz"))
    add_batch(spark, part, root, batch, after)


def run_upsert_job(spark: SparkSession, source: str, root: str, batch: str, jdbc: dict | None = None, partitions: int = 8) -> bool:
    """A batch of readings put into the table below ``root``, its distinct lists refreshed; False if it was there already."""
    readings = _read(spark, source, DEFAULT_LOWER_BOUND, DEFAULT_UPPER_BOUND, jdbc or {}, partitions)
    new = upsert_batch(spark, readings, root, batch)
    refresh_values(spark, root)
    return new


def run_reference_job(spark: SparkSession, stops_path: str, trips_path: str, sink: str, jdbc: dict | None = None, header: bool = True, partitions: int = 8) -> None:
    """Transit stops and trips from CSV files into tables ``transit_stops`` and ``trips`` (Parquet below ``sink``, or JDBC)."""
    kind, _, where = sink.partition(":")
    target = (lambda name: f"parquet:{where.rstrip('/')}/{name}") if kind == "parquet" else (lambda name: f"{kind}:{name}")
    load_reference_tables(spark, stops_path, trips_path, lambda rows, name: _write(rows, target(name), jdbc or {}, partitions), header)


def main(argv: list[str] | None = None) -> None:
    """Command line: ``fleet``, ``ingest``, ``stop-times``, ``detail``, ``daily``, ``upsert`` or ``reference``."""
    ap = argparse.ArgumentParser(prog="fleetstops.plans.jobs")
    sub = ap.add_subparsers(dest="job", required=True)
    f = sub.add_parser("fleet")
    f.add_argument("source")
    f.add_argument("sink")
    i = sub.add_parser("ingest")
    i.add_argument("raw_glob")
    i.add_argument("readings_path")
    i.add_argument("manifest_path")
    i.add_argument("--lenient", action="store_true")
    st = sub.add_parser("stop-times")
    st.add_argument("source")
    st.add_argument("sink")
    d = sub.add_parser("detail")
    d.add_argument("source")
    d.add_argument("path")
    day, up = sub.add_parser("daily"), sub.add_parser("upsert")
    for q in (day, up):
        q.add_argument("source")
        q.add_argument("root")
        q.add_argument("batch")
    day.add_argument("--after")
    ref = sub.add_parser("reference")
    ref.add_argument("stops_path")
    ref.add_argument("trips_path")
    ref.add_argument("sink")
    for q in (f, st, d, day):
        q.add_argument("--lower", default=None if q in (d, day) else DEFAULT_LOWER_BOUND)
        q.add_argument("--upper", default=None if q in (d, day) else DEFAULT_UPPER_BOUND)
    for q in (f, st, d, day, up, ref):
        q.add_argument("--jdbc-url")
        q.add_argument("--jdbc-driver")
        q.add_argument("--partitions", type=int, default=8)
    args = ap.parse_args(argv)
    spark = SparkSession.builder.appName(f"fleetstops-{args.job}").getOrCreate()
    if args.job == "ingest":
        run_ingest_job(spark, args.raw_glob, args.readings_path, args.manifest_path, args.lenient)
        return
    jdbc = {"url": args.jdbc_url, "driver": args.jdbc_driver}
    if args.job == "fleet":
        run_fleet_job(spark, args.source, args.sink, args.lower, args.upper, jdbc, args.partitions)
    elif args.job == "stop-times":
        run_stop_times_job(spark, args.source, args.sink, jdbc, args.lower, args.upper, args.partitions)
    elif args.job == "detail":
        run_detail_job(spark, args.source, args.path, args.lower, args.upper, jdbc, args.partitions)
    elif args.job == "daily":
        run_daily_job(spark, args.source, args.root, args.batch, args.after, args.lower, args.upper, jdbc, args.partitions)
    elif args.job == "upsert":
        run_upsert_job(spark, args.source, args.root, args.batch, jdbc, args.partitions)
    else:
        run_reference_job(spark, args.stops_path, args.trips_path, args.sink, jdbc, partitions=args.partitions)


if __name__ == "__main__":
    main()
