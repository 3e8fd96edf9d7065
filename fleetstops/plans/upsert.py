"""A readings table without duplicate keys, kept batch by batch, and counts of its distinct values.

The original inserts readings and then deletes, over the whole table, those whose (vehicle, time) a reading of larger id
also has. Here every batch does that for the parts it touches only:

* the table is partitioned by period of the report time and a hash bucket of the vehicle, so that all rows of a key are
  in one part; a batch reads and rewrites the parts of its own keys (dynamic partition overwrite), nothing else;
* a reading replaces one of smaller id with its key, whichever came first, so late duplicates and batches in any order
  give the table that one pass would;
* the rows' changes are counted by value for each watched column: plus one for a row that came, minus one for a row that
  went. The distinct lists of the original (vehicles, train assignments) are the values whose sum is above zero, and a
  refresh adds the changes since the last one, so it follows deletions and never reads the readings.

A batch is done in three steps, each of which can be repeated: its merged parts and changes are written beside the table
(``_pending/<batch>``, complete when ``_changes/<batch>`` is there), the parts are put into the table, and
``_applied/<batch>`` says so. A batch that failed is finished or begun anew by the next call, whichever batch that is
for; one that was applied is never applied again. One writer at a time; a reader may see some parts of a batch before
the others. Rows without vehicle or time never equal another and all stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.readings import dedupe_readings
from ..session import delete_path, list_path

#: Columns whose distinct values are counted.
WATCHED = ("vehicle_tag", "train_assignment")
PERIOD, BUCKET, BATCH = "_period", "_bucket", "_batch"
_LOG = "batch string, position long"


def _at(root: str, *names: str) -> str:
    return "/".join([root.rstrip("/"), *names])


def _done(spark: SparkSession, root: str, kind: str) -> list[str]:
    """Batches whose folder of this kind is complete."""
    return [b for b in list_path(spark, _at(root, kind)) if "_SUCCESS" in list_path(spark, _at(root, kind, b))]


def place(readings: DataFrame, period: str, buckets: int, key: str, time: str) -> DataFrame:
    """The part that each reading belongs to: its period (as text) and the bucket of its vehicle."""
    when = F.coalesce(F.date_format(F.date_trunc(period, F.col(time)), "yyyyMMddHH"), F.lit("none"))
    return readings.withColumns({PERIOD: when, BUCKET: F.pmod(F.xxhash64(key), F.lit(int(buckets))).cast("int")})


def _count_changes(came: DataFrame, went: DataFrame | None, watched) -> DataFrame:
    """(column, value, change): rows that came less rows that went, for each value whose number of rows changes."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in watched))).alias("w")
    rows = came.select(F.lit(1).alias("sign"), each)
    if went is not None:
        rows = rows.unionByName(went.select(F.lit(-1).alias("sign"), each))
    sums = rows.groupBy(F.col("w.column").alias("column"), F.col("w.value").alias("value")).agg(F.sum("sign").alias("change"))
    return sums.filter("change <> 0")


def touched_parts(new: DataFrame, root: str) -> DataFrame:
    """The table's rows in the parts that the placed readings ``new`` belong to; no other part is read.

    The driver learns the touched parts' names (it lists the table's folders by the same names anyway), so that the
    scan leaves out all others; the join takes the pairs that are touched out of the periods and buckets that are.
    """
    spark, touched = new.sparkSession, new.select(PERIOD, BUCKET).distinct()
    names = touched.collect()
    table = spark.read.schema(new.schema).parquet(_at(root, "data"))
    table = table.filter(F.col(PERIOD).isin({r[PERIOD] for r in names}) & F.col(BUCKET).isin({r[BUCKET] for r in names}))
    return table.join(touched, [PERIOD, BUCKET], "left_semi").select(*new.columns)


def _prepare(spark: SparkSession, readings: DataFrame, root: str, batch: str, how: dict, watched) -> None:
    """Write the touched parts as they will be, then the changes."""
    columns = readings.columns
    delete_path(spark, _at(root, "_new", batch))
    place(readings, **how).withColumn(BATCH, F.lit(batch)).write.mode("overwrite").parquet(_at(root, "_new", batch))
    new = spark.read.parquet(_at(root, "_new", batch))
    there, merged = None, new
    if list_path(spark, _at(root, "data")):
        there = touched_parts(new, root)
        merged = there.unionByName(new)
    kept = dedupe_readings(merged, keys=(how["key"], how["time"]))
    # Parts are balanced at run time: small ones share a task, a part with very many rows is several.
    kept = kept.select(*columns, BATCH, PERIOD, BUCKET).hint("rebalance", PERIOD, BUCKET)
    kept.write.mode("overwrite").partitionBy(PERIOD, BUCKET).parquet(_at(root, "_pending", batch))
    after = spark.read.schema(new.schema).parquet(_at(root, "_pending", batch))
    _count_changes(after, there, watched).write.mode("overwrite").parquet(_at(root, "_changes", batch))


def _apply(spark: SparkSession, root: str, batch: str) -> None:
    """Put a prepared batch's parts into the table; repeating it changes nothing."""
    if list_path(spark, _at(root, "_pending", batch)):  # else a failed call had come as far as to clear it
        # Written as it was prepared: nothing is dealt anew.
        schema = spark.read.parquet(_at(root, "_new", batch)).schema
        rows = spark.read.schema(schema).parquet(_at(root, "_pending", batch)).select(*(f.name for f in schema.fields))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PERIOD, BUCKET).parquet(_at(root, "data"))
    position = len(_done(spark, root, "_applied")) + 1
    spark.createDataFrame([(batch, position)], _LOG).coalesce(1).write.mode("overwrite").parquet(_at(root, "_applied", batch))
    for kind in ("_pending", "_new"):
        delete_path(spark, _at(root, kind, batch))


def upsert_batch(
    spark: SparkSession,
    readings: DataFrame,
    root: str,
    batch: str,
    *,
    period: str = "day",
    buckets: int = 16,
    key: str = "vehicle_tag",
    time: str = "report_time",
    watched=WATCHED,
) -> bool:
    """Add a batch of readings to the table below ``root``; False if a batch of this name is in it already.

    ``period``, ``buckets`` and ``watched`` must be the same for all batches of a table. A batch is known by its name:
    the same readings under another name change nothing either, but for rows without vehicle or time.
    """
    applied, prepared = set(_done(spark, root, "_applied")), _done(spark, root, "_changes")
    for left in sorted(set(prepared) - applied):
        _apply(spark, root, left)
        applied.add(left)
    if batch in applied:
        return False
    _prepare(spark, readings, root, batch, {"period": period, "buckets": buckets, "key": key, "time": time}, watched)
    _apply(spark, root, batch)
    return True


def readings_table(spark: SparkSession, root: str) -> DataFrame:
    """The table's readings, with the name of the batch that each came with in column ``_batch``."""
    return spark.read.parquet(_at(root, "data")).drop(PERIOD, BUCKET)


def refresh_values(spark: SparkSession, root: str) -> DataFrame:
    """(column, value, rows) of the watched columns after all applied batches; reads the last refresh and the changes since.

    Each refresh is a new folder, named by how many batches it holds; the one before it goes when it is written.
    """
    applied = _done(spark, root, "_applied")
    if not applied:
        return spark.createDataFrame([], "column string, value string, rows long")
    log = spark.read.schema(_LOG).parquet(*(_at(root, "_applied", b) for b in applied))
    seen = sorted(int(v) for v in _done(spark, root, "_values"))
    have = seen[-1] if seen else 0
    if have < len(applied):
        names = [r["batch"] for r in log.filter(F.col("position") > have).select("batch").collect()]  # one row a batch
        rows = spark.read.parquet(*(_at(root, "_changes", b) for b in names))
        if seen:
            rows = rows.unionByName(spark.read.parquet(_at(root, "_values", str(have))).withColumnRenamed("rows", "change"))
        sums = rows.groupBy("column", "value").agg(F.sum("change").alias("rows")).filter("rows <> 0")
        sums.write.mode("overwrite").parquet(_at(root, "_values", str(len(applied))))
        for old in seen:
            delete_path(spark, _at(root, "_values", str(old)))
    return spark.read.parquet(_at(root, "_values", str(len(applied))))


def distinct_list(spark: SparkSession, root: str, column: str) -> DataFrame:
    """The distinct values of a watched column (text), as the last refresh has them."""
    return refresh_values(spark, root).filter(F.col("column") == F.lit(column)).select(F.col("value").alias(column))
