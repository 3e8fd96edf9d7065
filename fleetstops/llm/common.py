"""Helpers the training-data operators share: tables, scratch tables, fresh names, one row of each key."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Fixed value: the white space of every word rule here, as a regular-expression class body.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables, read by Spark (the folder may be in any store Spark reads)."""
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Unset: a scratch folder in local mode, an error on a cluster."""
    sc = spark.sparkContext
    root = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(os.path.join("/tmp/checkpoints", uuid.uuid4().hex))
    return sc.getCheckpointDir()


def shared_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing uses yet."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that no column of ``df`` has, in any case of letters."""
    taken, name = {c.lower() for c in df.columns}, f"_{stem}"
    while name.lower() in taken:
        name = "_" + name
    return name


def q(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def keep_rows(df: DataFrame, keepers: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """The rows of ``df`` whose keys are in ``keepers``, one row for each of its rows.

    ``keys`` names the key columns of ``keepers`` and gives each as a column of ``df``; nulls match nulls.
    ``keepers`` also has ``times``, how many rows of ``df`` have the key. Keys met once, nearly all, go through
    a semi-join that moves no other column; of rows that share a key, the least by their other columns stays.
    """
    names = {k: fresh(df, f"key_{k}") for k in keys}
    own = df.withColumns({names[k]: c for k, c in keys.items()})

    def of(part: DataFrame) -> DataFrame:
        part = part.select(*(F.col(k).alias(f"_of_{k}") for k in keys))
        on = [q(names[k]).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
        return own.join(part, on, "left_semi")

    once = of(keepers.filter("times = 1")).select(*map(q, df.columns))
    rest = of(keepers.filter("times > 1")).groupBy(*map(q, names.values())).agg(F.min(F.struct(*map(q, df.columns))).alias("_row"))
    return once.unionByName(rest.select(*(F.col("_row")[c].alias(c) for c in df.columns)))


def sample_keys(keys: DataFrame, most: int) -> DataFrame:
    """At most ``most`` different rows of ``keys`` (narrow columns), the least by hash: the same ones on every run.

    After a count, only hashes below about twice the wanted share go on, so the one task that ranks them gets about
    2 ``most`` rows, however large the table.
    """
    keys = keys.distinct()
    span = 1 << 62
    below = span if (n := keys.count()) <= 2 * most else span // n * 2 * most
    place = F.pmod(F.xxhash64(*map(q, keys.columns)), F.lit(span))
    low = keys.withColumn(at := fresh(keys, "place"), place).filter(q(at) < F.lit(below))
    return low.orderBy(at, *map(q, keys.columns)).limit(most).drop(at)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers that don't inherit it by path (done once a session)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    there = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if spark.sparkContext.master.startswith("local["):
        there.append(os.getcwd())
    if root in map(os.path.abspath, filter(None, there)) or spark.sparkContext.applicationId in _SHIPPED:
        return
    name = __name__.split(".")[0]
    made = shutil.make_archive(os.path.join(tempfile.mkdtemp(), name), "zip", root, name)
    spark.sparkContext.addPyFile(made)
    _SHIPPED.add(spark.sparkContext.applicationId)


def map_rows(df: DataFrame, function, schema: str | StructType, rows: int = 256) -> DataFrame:
    """``function`` on Arrow batches of at most ``rows`` rows, so that very long texts don't meet in one step.

    It takes a record batch and returns one of ``schema`` (or a dict of columns); nothing is kept between batches.
    """
    ship(df.sparkSession)
    kind = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = function(batch.slice(at, rows))
                yield pa.RecordBatch.from_pydict(out, schema=kind) if isinstance(out, dict) else out

    return df.mapInArrow(run, schema)
