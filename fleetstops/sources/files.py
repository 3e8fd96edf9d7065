"""File sources: raw text glob (S1), CSV with an explicit schema (S2), profiling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_raw_text(
    spark: SparkSession, path_or_glob, with_file_name: bool = False, spread: int | None = None
) -> DataFrame:
    """Every line of every matching file as one ``value`` column.

    Plain text files are split by Spark into scan partitions
    (``spark.sql.files.maxPartitionBytes``), so a glob over thousands of daily
    files is read in parallel and one big file is read by many tasks.
    Compressed files (gzip) cannot be split: such a file is read by one task. With
    ``spread`` the lines are then dealt round-robin into that many partitions, so
    the cleaning and everything after it do not stay in the reading task.
    With ``with_file_name`` the source file's full path is kept (``_metadata`` column).
    """
    df = spark.read.text(path_or_glob)
    if with_file_name:
        df = df.select("value", F.col("_metadata.file_path").alias("file_name"))
    if spread:
        df = df.repartition(int(spread))
    return df


def read_csv_with_schema(
    spark: SparkSession, path, schema: T.StructType, header: bool = False, mode: str = "PERMISSIVE"
) -> DataFrame:
    """CSV with a given schema (nothing inferred); the header option is explicit."""
    return spark.read.schema(schema).option("header", str(bool(header)).lower()).option("mode", mode).csv(path)


def profile(df: DataFrame, n: int = 20) -> dict:
    """First row, first ``n`` rows, schema text, partition count and row count.

    Only ``n`` + 1 rows and one count travel to the driver.
    """
    rows = df.take(n)
    return {
        "first": rows[0] if rows else None,
        "rows": rows,
        "schema": df.schema.simpleString(),
        "partitions": df.rdd.getNumPartitions(),
        "count": df.count(),
    }
