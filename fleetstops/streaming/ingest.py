"""Incremental ingestion of daily position files as they arrive (S12 with Structured Streaming).

The batch ingest cleans a fixed set of files. Here the same cleaning runs over
a folder that keeps receiving files: the file source remembers which files it
has taken (in the query's checkpoint folder), each
micro-batch is cleaned and typed with the batch operators, and ``foreachBatch``
writes

* the typed readings into ``readings_path/batch_id=<n>`` (overwrite of that
  folder only, so a replayed batch after a failure replaces its own output), and
* one manifest row per source file that gave readings: full path, readings, batch id. Default ids go on from there:
  dense over all batches, in the order of time inside each.

Dedupe across batches is left to :func:`fleetstops.operators.readings.dedupe_readings`
over the accumulated table, as in the original flow (insert, then delete duplicates).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import clean_raw_lines, promote_readings

def _typed_batch(raw: DataFrame, first_id: int, reading_id_from: str | None, lenient: bool) -> DataFrame:
    staging = clean_raw_lines(raw, keep=["file_name"])
    typed = promote_readings(staging, reading_id_from=reading_id_from, keep=["file_name"], lenient=lenient)
    return typed if reading_id_from else typed.withColumn("reading_id", F.col("reading_id") + F.lit(first_id))


def _readings_before(spark: SparkSession, manifest_path: str, batch_id: int) -> int:
    """Readings of all earlier batches, from the manifest (a row per file): where a batch's dense ids go on.

    A replayed batch gets the same ids again, since its own rows don't count.
    """
    if batch_id == 0:
        return 0
    schema = "file_name string, readings long, batch_id long"
    earlier = spark.read.schema(schema).parquet(manifest_path).filter(F.col("batch_id") < batch_id)
    return earlier.agg(F.sum("readings")).first()[0] or 0


def start_ingest_stream(
    spark: SparkSession,
    source_dir: str,
    readings_path: str,
    manifest_path: str,
    *,
    checkpoint: str,
    max_files_per_trigger: int | None = None,
    reading_id_from: str | None = None,
    lenient: bool = False,
    available_now: bool = True,
    processing_time: str | None = None,
) -> StreamingQuery:
    """Start the ingestion query; returns the running ``StreamingQuery``.

    ``checkpoint``: the stream's folder in shared storage, the same one on every restart, so that no file is taken twice.

    ``available_now`` processes every file present now (in batches of
    ``max_files_per_trigger``) and stops; otherwise the query keeps watching
    ``source_dir`` with a ``processing_time`` trigger.
    """
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    raw = reader.load(source_dir).select("value", F.col("_metadata.file_path").alias("file_name"))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        # One micro-batch is bounded by maxFilesPerTrigger; it is kept for its two writes
        # (lost blocks are recomputed from the batch's files).
        first_id = 0 if reading_id_from else _readings_before(batch.sparkSession, manifest_path, batch_id)
        typed = _typed_batch(batch, first_id, reading_id_from, lenient).persist()
        try:
            typed.drop("file_name").write.mode("overwrite").parquet(
                os.path.join(readings_path, f"batch_id={batch_id}")
            )
            counts = typed.groupBy("file_name").agg(F.count(F.lit(1)).alias("readings"))
            counts.write.mode("overwrite").parquet(os.path.join(manifest_path, f"batch_id={batch_id}"))
        finally:
            typed.unpersist()

    writer = raw.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()
