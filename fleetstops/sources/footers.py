"""Counts and bounds of a stored table from its Parquet footers (A3, A4, A7 without reading rows)."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _aggregates(columns) -> list:
    bounds = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))]
    return [F.count(F.lit(1)).alias("row_count"), *bounds]


def footer_aggregates(spark: SparkSession, path: str, columns) -> DataFrame:
    """The lazy question, in a session of its own whose Parquet reader takes counts, minima and maxima from the footers.

    It fails when it runs if a file lacks the statistics; :func:`stored_bounds` does not.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return own.read.parquet(path).agg(*_aggregates(columns))


def stored_bounds(spark: SparkSession, path: str, columns) -> DataFrame:
    """One row: ``row_count``, and ``min_<c>`` and ``max_<c>`` of numeric columns, of the Parquet table in folder ``path``.

    From the footers where all files have the statistics; where one lacks them (NaN among its values, say), by reading
    the columns. Runs when it is called; an empty table gives 0 and NULLs.
    """
    try:
        rows = footer_aggregates(spark, path, columns).collect()
    except (PySparkException, Py4JJavaError):  # a real fault shows again below
        rows = []
    plain = spark.read.parquet(path).agg(*_aggregates(columns))
    if not rows or rows[0]["row_count"] is None:  # no statistics; no file with rows
        rows = plain.collect()
    return spark.createDataFrame(rows, plain.schema)
