"""Exact dedup against a persistent digest index, bucketed and sorted by digest (DataFrame operations only).

The index is an external Parquet table ``(digest, keep_id, batch)`` bucketed and sorted by ``digest``. A batch is
reduced to one row per digest (combined before the shuffle, so a text held by a third of all rows costs one row
a task), joined with the index by a sort-merge anti-join in which only the batch moves, and what is new is
appended to the index. The index's folder holds its number of buckets (in RECORD, which table reads pass over).

A batch has a name, and the anti-join looks at the rows of other batches only: a batch that is run again, because its
result was lost after the index had its digests, gives the same result again and adds no row twice. Appends add files
to each bucket, which Spark then sorts again on each join; :func:`compact` makes them one sorted file a bucket, in a
folder of its own (``_part-<n>``) that counts from when it is complete. One batch at a time.

Cases: null text counts as empty; texts are equal when they are after runs of white space become one space; of
equal texts the row with the smallest doc_id stays (null ids last; among equal ids one row); a batch text that
other batches have already keeps no row and points to the index's id. An empty batch gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete_path, list_path
from .common import SPACE, keep_rows, materialize, shared_path, table

#: Buckets of a new index, where its maker states none. A bucket should fit a task's memory, and with no fewer buckets
#: than shuffle partitions Spark moves the batch to the index's buckets and leaves the index where it is.
BUCKETS = 32
RECORD = "_buckets"
PART = "_part-"
#: The name of a batch that is the only one of its index.
ONLY = "all"


def made_with(spark: SparkSession, path: str) -> int | None:
    """The number of buckets that the index in folder ``path`` was made with; None where none is recorded."""
    try:
        rows = spark.read.schema("buckets int").parquet(f"{path.rstrip('/')}/{RECORD}").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return rows[0]["buckets"] if rows else None


def session_buckets(spark: SparkSession, path: str | None = None) -> int:
    """The buckets of the index in folder ``path``; for a new index, what matches the session's shuffles."""
    return path and made_with(spark, path) or max(BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The complete compacted versions of the index in folder ``path``."""
    names = [n for n in list_path(spark, path) if n.startswith(PART)]
    return sorted(int(n.removeprefix(PART)) for n in names if "_SUCCESS" in list_path(spark, f"{path.rstrip('/')}/{n}"))


def digest(text: Column) -> Column:
    """SHA-256 (hex) of the normalised text."""
    return F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", " ").cast("binary"), 256)


def _table_name() -> str:
    return f"digest_index_{uuid.uuid4().hex}"


def open_index(spark: SparkSession, path: str, buckets: int = BUCKETS) -> str:
    """Register the index that lives (or will live) in folder ``path``; returns its table name.

    The folder outlives the session; ``buckets`` must be what the index was made with, else a ValueError is raised.
    """
    made = made_with(spark, path)
    if made not in (None, int(buckets)):
        raise ValueError(f"the index in {path} has {made} buckets, not {buckets}")
    name, versions = _table_name(), _versions(spark, path)
    place = (f"{path.rstrip('/')}/{PART}{versions[-1]}" if versions else path).replace("'", "\\'")
    spark.sql(
        f"CREATE TABLE {name} (digest STRING, keep_id BIGINT, batch STRING) USING parquet "
        f"CLUSTERED BY (digest) SORTED BY (digest) INTO {int(buckets)} BUCKETS LOCATION '{place}'"
    )
    if made is None:
        if not spark.table(name).isEmpty():
            spark.sql(f"DROP TABLE {name}")
            raise ValueError(f"the index in {path} has rows but no number of buckets")
        # An empty index: made here.
        one = spark.range(0, 1, 1, 1).select(F.lit(int(buckets)).alias("buckets"))
        one.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{RECORD}")
    return name


def compact(spark: SparkSession, path: str, buckets: int = BUCKETS) -> str:
    """One sorted file a bucket in place of one for each append; returns the new version's table name.

    Nothing moves between tasks. A version that isn't complete is never read, and older compacted ones are deleted
    after it is, so tables opened before must not be used any more.
    """
    rows, versions = spark.table(open_index(spark, path, buckets)), _versions(spark, path)
    new = versions[-1] + 1 if versions else 1
    place = f"{path.rstrip('/')}/{PART}{new}"
    delete_path(spark, place)
    # The scan's buckets are its tasks: each sorts its own rows and writes one file.
    rows = rows.dropDuplicates(["digest"]).select("digest", "keep_id", "batch")
    rows.write.bucketBy(int(buckets), "digest").sortBy("digest").option("path", place).mode("overwrite").format("parquet").saveAsTable(name := _table_name())
    for old in versions:
        delete_path(spark, f"{path.rstrip('/')}/{PART}{old}")
    return name


def _of_others(index: DataFrame, batch: str) -> DataFrame:
    return index.filter(~F.col("batch").eqNullSafe(batch))


def new_digests(groups: DataFrame, index: str, batch: str = ONLY) -> DataFrame:
    """Rows of ``groups`` (one per digest) that other batches lack: a sort-merge anti-join on the buckets."""
    known = _of_others(groups.sparkSession.table(index), batch).select("digest")
    return groups.join(known.hint("merge"), "digest", "left_anti")


def append(new: DataFrame, index: str, buckets: int = BUCKETS, batch: str = ONLY) -> None:
    """Append a batch's new digests to the index, one sorted file a bucket; digests that the batch has there already stay as they are."""
    own = new.sparkSession.table(index).filter(F.col("batch") == batch).select("digest")
    rows = new.select("digest", "keep_id").join(own.hint("merge"), "digest", "left_anti").withColumn("batch", F.lit(batch))
    rows.repartition(buckets, "digest").sortWithinPartitions("digest").write.insertInto(index)


def _narrow(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, row): what dedup decides on, written once so that row numbers stay as they are."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest(F.col("text")).alias("digest"))
    return materialize(ids.withColumn("row", F.monotonically_increasing_id()), "digests")


def _groups(narrow: DataFrame) -> DataFrame:
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    return narrow.groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size")).select(
        "digest", "group_size", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row")
    )


def _decide(narrow: DataFrame, index: str, buckets: int, batch: str) -> DataFrame:
    """(digest, keep_id, keep_row, group_size) of a batch's digests; its new ones are in the index afterwards."""
    groups = _groups(narrow)
    new = materialize(new_digests(groups, index, batch), "new-digests")
    append(new, index, buckets, batch)
    # Digests that other batches brought: their ids come from the index.
    known = _of_others(narrow.sparkSession.table(index), batch).select("digest", "keep_id")
    old = groups.select("digest", "group_size").join(known.hint("merge"), "digest")
    return new.select("digest", "keep_id", "keep_row", "group_size").unionByName(
        old.select("digest", "keep_id", F.lit(None).cast("long").alias("keep_row"), "group_size")
    )


def _rows(narrow: DataFrame, decided: DataFrame) -> DataFrame:
    stays = F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False))
    return narrow.join(decided, "digest").select("doc_id", "keep_id", "group_size", stays.alias("kept"), F.col("digest").alias("text_sha256"))


def dedup(docs: DataFrame, index: str, buckets: int = BUCKETS, batch: str | None = None) -> DataFrame:
    """Deduplicate a batch against the index, append its new texts, and return a row for each batch row.

    Columns: doc_id, keep_id, group_size (equal rows in the batch), kept, text_sha256. ``batch`` names the batch (give
    the same name when it is run again); without one it gets a name of its own, and a second run is another batch.
    """
    narrow = _narrow(docs)
    return _rows(narrow, _decide(narrow, index, buckets, batch or uuid.uuid4().hex))


def dedup_in_batches(docs: DataFrame, index: str, buckets: int = BUCKETS, batches: int = 3) -> DataFrame:
    """:func:`dedup` of all rows in ascending ranges of doc_id (rows without one last), each a batch against one index.

    The texts are read once; a batch is a range of the narrow digests. group_size counts equal rows over all batches.
    """
    narrow = _narrow(docs)
    parts = [k / batches for k in range(1, batches)]
    cuts = sorted(set(narrow.approxQuantile("doc_id", parts, 0.05))) if parts else []
    number = F.lit(0)
    for c in cuts:
        number = number + F.when(F.col("doc_id").isNull() | (F.col("doc_id") > F.lit(int(c))), 1).otherwise(0)
    stays = None
    for k in range(len(cuts) + 1):
        part = narrow.filter(number == k)
        one = materialize(_decide(part, index, buckets, f"range-{k}").select("digest", "keep_id", "keep_row").filter("keep_row IS NOT NULL"), "kept")
        stays = one if stays is None else stays.unionByName(one)
    # The batch that brought a digest keeps one of its rows; in all other rows it is a copy.
    sizes = narrow.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
    return _rows(narrow, materialize(stays.join(sizes, "digest"), "decided"))


def keep_new(docs: DataFrame, index: str, buckets: int = BUCKETS, batch: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; their digests are appended to the index."""
    narrow = _narrow(docs)
    decided = materialize(_decide(narrow, index, buckets, batch or uuid.uuid4().hex).filter("keep_row IS NOT NULL"), "decided")
    chosen = decided.select(F.col("digest").alias("_digest"), "keep_id")
    same = (F.col("digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    keepers = narrow.join(chosen, same, "left_semi").groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("times"))
    return keep_rows(docs, keepers, {"doc_id": F.col("doc_id").cast("long"), "digest": digest(F.col("text"))})


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact dedup of all documents, in batches that meet in one index."""
    index = open_index(spark, shared_path(spark, "digest-index"), buckets := session_buckets(spark))
    return dedup_in_batches(table(spark, sf_dir, "documents"), index, buckets)


OP6_SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)
"""
