"""Ingestion: raw daily position files → typed, deduplicated readings; reference tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import clean_raw_lines, promote_readings
from ..operators.readings import dedupe_readings
from ..schemas import TRANSIT_STOPS, TRIPS
from ..sources.files import read_csv_with_schema, read_raw_text
from ..sources.tables import create_table_as


def ingest_avl(raw: DataFrame, *, reading_id_from: str | None = None, dedupe: bool = True, lenient: bool = False) -> DataFrame:
    """Raw lines → staging text → typed readings → one reading per (vehicle, time).

    Blank lines go, glued headers are cut, lines are split into nine fields and
    typed in one projection; duplicates keep the largest reading id. Ids are dense in the order of time unless
    taken from a column; malformed text raises unless ``lenient``.
    """
    staging = clean_raw_lines(raw)
    typed = promote_readings(staging, reading_id_from=reading_id_from, lenient=lenient)
    return dedupe_readings(typed) if dedupe else typed


def ingest_files(spark: SparkSession, glob: str, **kw) -> DataFrame:
    """Z1 over text files."""
    return ingest_avl(read_raw_text(spark, glob), **kw)


def listed_files(spark: SparkSession, glob: str) -> DataFrame:
    """The full paths of all files that a glob names, empty ones included, written as the file source writes them.

    The names come from the listing that Spark's driver makes of any file source; no content is read.
    """
    names = spark.read.text(glob).inputFiles()
    return spark.createDataFrame([(re.sub(r"^(\w+):///", r"\1:/", n),) for n in names], "file_name string")


def ingest_files_with_log(
    spark: SparkSession, glob: str, readings_path: str, manifest_path: str, *, reading_id_from: str | None = None, lenient: bool = False
) -> DataFrame:
    """Ingest many files at once and record, per source file, how many readings it gave.

    The typed rows are written once with their source file's full path; the manifest is
    then a grouped count over that single dictionary-encoded column of the
    written table (the raw text is not read twice), joined to the listing of the files, so that files
    that gave no reading are logged with 0. Returns the manifest.
    """
    raw = read_raw_text(spark, glob, with_file_name=True)
    staging = clean_raw_lines(raw, keep=["file_name"])
    typed = promote_readings(staging, reading_id_from=reading_id_from, keep=["file_name"], lenient=lenient)
    create_table_as(typed, readings_path)
    counts = spark.read.parquet(readings_path).groupBy("file_name").agg(F.count(F.lit(1)).alias("n"))
    manifest = listed_files(spark, glob).join(counts, "file_name", "left")
    manifest = manifest.select("file_name", F.coalesce("n", F.lit(0)).alias("readings"))
    manifest.write.mode("overwrite").parquet(manifest_path)
    return spark.read.parquet(manifest_path)


def read_reference_tables(spark: SparkSession, stops_path: str, trips_path: str, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """Transit stops and trips from CSV with explicit schemas (each from its own path)."""
    return (
        read_csv_with_schema(spark, stops_path, TRANSIT_STOPS, header=header),
        read_csv_with_schema(spark, trips_path, TRIPS, header=header),
    )


def load_reference_tables(spark: SparkSession, stops_path: str, trips_path: str, write, header: bool = True) -> None:
    """Transit stops and trips from CSV, each written to its own table by ``write(rows, name)``."""
    for name, rows in zip(("transit_stops", "trips"), read_reference_tables(spark, stops_path, trips_path, header), strict=True):
        write(rows, name)
