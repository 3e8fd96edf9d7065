"""Stop tables kept batch by batch: a new day reads only itself and a small carry table.

The original computes its stop tables once, over the whole history. Here they grow with the readings. After each batch
(a day, say) a carry table holds, per vehicle, what later batches need of everything before them:

* the last reading, an open stop end until the vehicle's next reading is known;
* the last moving reading, which stops without an id bound are measured from;
* the moving readings of the ``max_s`` seconds before the last reading: the only ones that an id-bounded stop shorter
  than ``max_s`` can begin at, whatever order ids have.

A batch runs the ordinary stop detection over its readings and the carry, and keeps the stop ends whose next reading
came with this batch. So the tables after the last batch equal those of one pass over all readings.

Layout below ``root``: ``stop_times/batch=<b>``, ``stops_detail/batch=<b>`` and ``carry/batch=<b>``, in this order. Each
write replaces its own folder, and a batch reads the carry of the batch before it only, so a batch that failed half
way is run again with the same arguments. Readings of a batch must be later, vehicle by vehicle, than those before; one
that isn't is refused (run the batches from that time on again). Readings without vehicle or time take no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import LONG_STOP_MAX_S, LONG_STOP_MIN_S, MAX_ID_GAP
from ..functions.time import floor_div, hour_of_day, stop_length_rounded, stop_length_seconds
from ..operators.stops import stop_ends_with_last_moving
from ..tuning import CHUNK_SECONDS

TABLES = ("stop_times", "stops_detail", "carry")
_COLUMNS = ["reading_id", "vehicle_tag", "report_time", "speed", "latitude", "longitude"]


def _folder(root: str, name: str, batch: str) -> str:
    return f"{root.rstrip('/')}/{name}/batch={batch}"


def carried(readings: DataFrame, max_s: int = LONG_STOP_MAX_S) -> DataFrame:
    """The readings that later batches need (see the module), with ``last``: is it the vehicle's last one?

    Vehicles' last times meet the readings by (vehicle, stretch of ``max_s`` seconds), three stretches a vehicle at
    most, so that one vehicle's many readings are many keys.
    """
    stretch = lambda t: floor_div(F.unix_timestamp(t), int(max_s))
    moving_at = F.when(F.col("speed") > 0, F.col("report_time"))
    ends = readings.groupBy(F.col("vehicle_tag").alias("_v")).agg(F.max("report_time").alias("_last"), F.max(moving_at).alias("_moving"))
    from_time = F.col("_last") - F.make_dt_interval(secs=F.lit(int(max_s)).cast("decimal(18,6)"))
    wanted = F.array_distinct(F.array_compact(F.array(stretch("_last"), stretch(from_time), stretch("_moving"))))
    ends = ends.select("*", from_time.alias("_from"), F.explode(wanted).alias("_s"))
    met = readings.withColumn("_s0", stretch("report_time")).join(ends, (F.col("vehicle_tag") == F.col("_v")) & (F.col("_s0") == F.col("_s")))
    is_last = F.col("report_time") == F.col("_last")
    near = (F.col("speed") > 0) & (F.col("report_time") >= F.least("_from", "_moving"))
    near = near & ((F.col("report_time") >= F.col("_from")) | (F.col("report_time") == F.col("_moving")))
    return met.filter(is_last | F.coalesce(near, F.lit(False))).select(*_COLUMNS, is_last.alias("last"))


def add_batch(
    spark: SparkSession,
    readings: DataFrame,
    root: str,
    batch: str,
    after: str | None = None,
    *,
    max_id_gap: int | None = MAX_ID_GAP,
    min_s: int = LONG_STOP_MIN_S,
    max_s: int = LONG_STOP_MAX_S,
    chunk_seconds: int = CHUNK_SECONDS,
) -> None:
    """Add the readings of ``batch`` to the tables below ``root``; ``after`` names the batch before it (None: the first).

    The settings must be the same for all batches.
    """
    new = readings.select(*_COLUMNS).filter(F.col("vehicle_tag").isNotNull() & F.col("report_time").isNotNull())
    both = new.withColumn("fresh", F.lit(True))
    if after is not None:
        carry = spark.read.parquet(_folder(root, "carry", after))
        first = new.groupBy("vehicle_tag").agg(F.min("report_time").alias("first"))
        known = carry.groupBy("vehicle_tag").agg(F.max("report_time").alias("known"))
        late = first.join(known, "vehicle_tag").filter("first <= known").select("vehicle_tag", "first", "known").head(1)
        if late:
            raise ValueError(f"vehicle {late[0][0]} has a reading at {late[0][1]}, not after {late[0][2]} of the batches before {batch}")
        both = both.unionByName(carry.select(*_COLUMNS, F.col("last").alias("fresh")))
    ends = stop_ends_with_last_moving(both, max_id_gap=None, chunk_seconds=chunk_seconds).filter("fresh")
    kind = both.schema["report_time"].dataType
    times = ends.select(
        "vehicle_tag",
        F.col("report_time").alias("stopped_at"),
        F.col("last_moving_time").alias("stopped_since"),
        stop_length_rounded("report_time", "last_moving_time", kind).alias("stopped_for"),
        "latitude",
        "longitude",
    )
    times.write.mode("overwrite").parquet(_folder(root, "stop_times", batch))
    ends = stop_ends_with_last_moving(both, max_id_gap=max_id_gap, max_s=max_s, chunk_seconds=chunk_seconds).filter("fresh")
    detail = ends.withColumn("stopped_for", stop_length_seconds("report_time", "last_moving_time"))
    detail = detail.filter((F.col("stopped_for") > F.lit(int(min_s))) & (F.col("stopped_for") < F.lit(int(max_s))))
    detail = detail.select("report_time", "vehicle_tag", "stopped_for", hour_of_day("report_time").alias("hour_of_day"), "latitude", "longitude")
    detail.write.mode("overwrite").parquet(_folder(root, "stops_detail", batch))
    carried(both.drop("fresh"), max_s).write.mode("overwrite").parquet(_folder(root, "carry", batch))


def stop_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """``stop_times`` (with coordinates) or ``stops_detail`` as all batches so far give it."""
    if name not in TABLES[:2]:
        raise ValueError(f"no stop table {name!r}")
    return spark.read.parquet(f"{root.rstrip('/')}/{name}").drop("batch")
