"""Cleaning of raw position lines into staging text columns and typed readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..constants import RAW_FIELDS
from ..functions.cleaning import (
    empty_to_null_double,
    empty_to_null_double_lenient,
    parse_report_time,
    parse_report_time_strict,
    strip_header,
    truncate_text,
)
from ..functions.time import floor_div
from ..tuning import ID_PIECE_SECONDS, UNTIMED_PIECES


def drop_blank_lines(raw: DataFrame, column: str = "value") -> DataFrame:
    """Keep non-empty lines."""
    return raw.filter(F.col(column) != F.lit(""))


def strip_headers(raw: DataFrame, column: str = "value") -> DataFrame:
    """P2 on a DataFrame: the glued header is cut from every line, the data after it stays."""
    return raw.withColumn(column, strip_header(column))


def split_fields(raw: DataFrame, column: str = "value", fields=RAW_FIELDS, keep=()) -> DataFrame:
    """P3 + P4: comma split into named text columns; missing fields are NULL; working columns dropped."""
    parts = F.split(F.col(column), ",")
    return raw.select(*[F.col(k) for k in keep], *[F.get(parts, i).alias(name) for i, name in enumerate(fields)])


def time_ordered_ids(df: DataFrame, name: str = "reading_id", time: str = "report_time", piece_seconds: int = ID_PIECE_SECONDS) -> DataFrame:
    """Ids 1, 2, 3, … without gaps in the order of time, then of the other columns as they stand.

    The order follows from the rows' content alone, so the ids don't depend on files, partitions or retries (rows that
    are equal in all columns are interchangeable); rows without a time come first, in the order of a hash of their columns,
    then of the columns. Rows are numbered inside calendar pieces of ``piece_seconds`` (those without a time inside ranges of
    the hash); the offset of a piece is the sum of the counts before it, per day and inside the day,
    so nothing larger than one piece's rows, one day's pieces or one row per day meets in one task. Both uses of the
    shuffle need the same columns (the hash), so it is made once.
    """
    day, piece, same = "_fs_day", "_fs_piece", "_fs_same"
    seconds = F.unix_timestamp(F.col(time))
    untimed = F.lit(-(1 << 62))
    by_hash = untimed + F.pmod(F.xxhash64(*df.columns), F.lit(UNTIMED_PIECES))
    days, pieces = F.coalesce(floor_div(seconds, 86_400), untimed), F.coalesce(floor_div(seconds, int(piece_seconds)), by_hash)
    dealt = df.withColumn(day, days).withColumn(piece, pieces).repartition(F.col(day), F.col(piece))
    order = [time, *[c for c in df.columns if c != time]]
    numbered = dealt.withColumn("_fs_n", F.row_number().over(Window.partitionBy(day, piece).orderBy(*order)))
    counts = dealt.groupBy(day, piece).agg(F.count(F.lit(1)).alias("n"), F.max(F.hash(*df.columns)).alias(same)).filter(F.col(same).isNotNull())
    before = Window.unboundedPreceding, -1
    in_day = counts.select(day, piece, F.coalesce(F.sum("n").over(Window.partitionBy(day).orderBy(piece).rowsBetween(*before)), F.lit(0)).alias("_fs_in_day"))
    days = counts.groupBy(day).agg(F.sum("n").alias("n"))
    days = days.select(day, F.coalesce(F.sum("n").over(Window.orderBy(day).rowsBetween(*before)), F.lit(0)).alias("_fs_before"))
    out = numbered.join(in_day.join(days, day), [day, piece])
    return out.select((F.col("_fs_before") + F.col("_fs_in_day") + F.col("_fs_n")).cast("long").alias(name), *df.columns)


def assign_reading_id(df: DataFrame, from_column: str | None = None, name: str = "reading_id", lenient: bool = False) -> DataFrame:
    """A surrogate key: dense in the order of time (:func:`time_ordered_ids`), or the number in a text column.

    Malformed text raises unless ``lenient``, which turns it into NULL.
    """
    if from_column is None:
        return time_ordered_ids(df, name)
    text = F.col(from_column)
    return df.withColumn(name, text.try_cast("long") if lenient else text.cast("long"))


def promote_readings(staging: DataFrame, reading_id_from: str | None = None, keep=(), lenient: bool = False) -> DataFrame:
    """Typed readings from staging text (P5 + P6 + P7 + P8).

    Latitude and longitude keep their own names (no swap). '' becomes NULL for
    the four numeric fields; other malformed text in a number, time or id raises (as the original
    conversion does) unless ``lenient``, which turns it into NULL (see :func:`count_rejects`).
    Without ``reading_id_from`` ids are dense in the order of time.
    """
    num = empty_to_null_double_lenient if lenient else empty_to_null_double
    ids = []
    if reading_id_from is not None:
        text = F.col(reading_id_from)
        ids = [(text.try_cast("long") if lenient else text.cast("long")).alias("reading_id")]
    typed = staging.select(
        *[F.col(k) for k in keep],
        *ids,
        truncate_text("rev").alias("rev"),
        (parse_report_time("report_time") if lenient else parse_report_time_strict("report_time")).alias("report_time"),
        truncate_text("vehicle_tag").alias("vehicle_tag"),
        num("speed").alias("speed"),
        num("heading").alias("heading"),
        truncate_text("train_assignment").alias("train_assignment"),
        truncate_text("predictable").alias("predictable"),
        num("latitude").alias("latitude"),
        num("longitude").alias("longitude"),
    )
    if ids:
        return typed
    return time_ordered_ids(typed).select(*keep, "reading_id", *[c for c in typed.columns if c not in keep])


def count_rejects(staging: DataFrame, reading_id_from: str | None = None) -> DataFrame:
    """One row: how many lines hold text that ``lenient`` turns into NULL, in all and by field."""
    bad = {c: F.col(c).isNotNull() & (F.col(c) != "") & F.col(c).try_cast("double").isNull() for c in ("speed", "heading", "latitude", "longitude")}
    bad["report_time"] = F.col("report_time").isNotNull() & parse_report_time("report_time").isNull()
    if reading_id_from is not None:
        bad[reading_id_from] = F.col(reading_id_from).isNotNull() & F.col(reading_id_from).try_cast("long").isNull()
    some = F.lit(False)
    for b in bad.values():
        some = some | b
    return staging.agg(F.count(F.lit(1)).alias("lines"), F.count_if(some).alias("rejected"), *[F.count_if(b).alias(f"bad_{c}") for c, b in bad.items()])


def clean_raw_lines(raw: DataFrame, column: str = "value", keep=()) -> DataFrame:
    """P1 + P2 + P3 + P4: raw text lines → staging table of nine text columns."""
    return split_fields(strip_headers(drop_blank_lines(raw, column), column), column, keep=keep)
