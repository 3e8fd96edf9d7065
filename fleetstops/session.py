"""Session helpers: a configured session for tests and benches, and shared folders.

On a cluster the session comes from ``spark-submit`` and already names a shared
checkpoint folder in ``spark.checkpoint.dir``; these helpers only read it. A
folder of our own is set only when the setting is missing (local tests).
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "fleetstops") -> SparkSession:
    """A session for tests, benches and local runs: AQE on, UTC session zone, UI off."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of ``spark.checkpoint.dir``.

    Where none is set: a scratch folder in local mode (one machine), an error on a cluster, whose executors could not
    see a folder of the driver's machine.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        configured = os.path.join("/tmp/checkpoints", uuid.uuid4().hex)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def materialize(df, name: str):
    """Write ``df`` as a Parquet table under the shared checkpoint folder and read it back.

    Cuts lineage like ``checkpoint()``, but the files are compressed and columnar:
    later readers fetch only the columns they use and AQE sees real sizes. Lost
    executors do not lose it (the folder is the cluster's shared one).
    """
    path = shared_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder, for written intermediate tables."""
    root = ensure_checkpoint_dir(spark)
    return os.path.join(root, f"{name}-{uuid.uuid4().hex}")


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def list_path(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any file system that Spark reads, in order; empty where there is no such folder."""
    fs, where = _folder(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder and all below it, if it is there."""
    fs, where = _folder(spark, path)
    fs.delete(where, True)


def recommended_conf(input_bytes: int, total_cores: int, partition_bytes: int = 256 * 1024**2) -> dict:
    """Settings sized for a given input (e.g. ~100 TB on a large cluster).

    Shuffle partitions are chosen so that one partition holds about
    ``partition_bytes`` of the full input (AQE coalesces them when less data
    reaches a shuffle), rounded up to a multiple of the cores; scan splits stay
    at 128 MB; AQE skew handling splits oversized join partitions.
    """
    n = max(total_cores, -(-int(input_bytes) // int(partition_bytes)))
    n = -(-n // total_cores) * total_cores
    return {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.files.maxPartitionBytes": str(128 * 1024**2),
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
