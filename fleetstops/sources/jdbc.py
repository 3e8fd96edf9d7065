"""JDBC sources and sinks.

Reads push work into the database: a whole table, a subquery
(``(SELECT …) AS subq`` or the ``query`` option), and a range-split parallel
read on a numeric, date or timestamp column. As in Spark's JDBC source, the
bounds only set the stride of the partitions; rows outside them are still read
(by the first and last partition), filtering is left to the WHERE clause.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _reader(spark: SparkSession, url: str, properties: dict | None):
    r = spark.read.format("jdbc").option("url", url)
    for k, v in (properties or {}).items():
        r = r.option(k, v)
    return r


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict | None = None) -> DataFrame:
    """A whole table (or a ``(SELECT …) AS name`` derived table)."""
    return _reader(spark, url, properties).option("dbtable", table).load()


def read_jdbc_query(spark: SparkSession, url: str, query: str, properties: dict | None = None) -> DataFrame:
    """A subquery run by the database; only its result is transferred."""
    return _reader(spark, url, properties).option("query", query).load()


def read_jdbc_partitioned(
    spark: SparkSession,
    url: str,
    table: str,
    column: str,
    lower,
    upper,
    num_partitions: int = 8,
    properties: dict | None = None,
    timestamp_ntz: bool = True,
) -> DataFrame:
    """``num_partitions`` parallel range reads on ``column``.

    Timestamp partition columns come back as ``timestamp``; with ``timestamp_ntz``
    they are turned into ``timestamp_ntz`` (the readings' type) after the read.
    """
    df = (
        _reader(spark, url, properties)
        .option("dbtable", table)
        .option("partitionColumn", column)
        .option("lowerBound", str(lower))
        .option("upperBound", str(upper))
        .option("numPartitions", int(num_partitions))
        .load()
    )
    if timestamp_ntz:
        for f in df.schema.fields:
            if isinstance(f.dataType, T.TimestampType):
                df = df.withColumn(f.name, F.col(f.name).cast("timestamp_ntz"))
    return df


def write_jdbc(
    df: DataFrame,
    url: str,
    table: str,
    mode: str = "overwrite",
    properties: dict | None = None,
    num_partitions: int | None = None,
    batch_size: int | None = None,
) -> None:
    """Write a DataFrame to a table; each partition writes over its own connection.

    ``num_partitions`` caps the number of concurrent connections (Spark coalesces
    to it before writing); ``batch_size`` sets rows per insert batch.
    """
    w = df.write.format("jdbc").mode(mode).option("url", url).option("dbtable", table)
    if num_partitions:
        w = w.option("numPartitions", int(num_partitions))
    if batch_size:
        w = w.option("batchsize", int(batch_size))
    for k, v in (properties or {}).items():
        w = w.option(k, v)
    w.save()


def copy_table(
    spark: SparkSession, url: str, src: str, dst: str, properties: dict | None = None, by: str | None = None, lower=None, upper=None, num_partitions: int = 8
) -> None:
    """Table-to-table copy through Spark.

    ``by``, ``lower``, ``upper``: read and write in ``num_partitions`` ranges of that column at once (S5); without
    them the database gives no way to split the table and it passes through one task, fit for small tables.
    """
    if by is None:
        rows = read_jdbc(spark, url, src, properties)
    else:
        rows = read_jdbc_partitioned(spark, url, src, by, lower, upper, num_partitions, properties, timestamp_ntz=False)
    write_jdbc(rows, url, dst, "overwrite", properties, num_partitions=num_partitions)
