from collections import Counter

import pytest
from pyspark.sql import functions as F

from fleetstops.llm import common as cm


def test_sample_is_the_least_by_hash_and_bounded(spark):
    keys = spark.range(20_000).select((F.col("id") % 5_000).alias("k"))
    got = [r.k for r in cm.sample_keys(keys, 100).collect()]
    assert len(set(got)) == 100 and got == [r.k for r in cm.sample_keys(keys.repartition(7), 100).collect()]
    assert sorted(r.k for r in cm.sample_keys(spark.range(30).withColumnRenamed("id", "k"), 100).collect()) == list(range(30))
    assert cm.sample_keys(keys.limit(0), 5).count() == 0
    # What the one ranking task gets is about twice the sample, not the table.
    plan = cm.sample_keys(keys, 100)._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan and "GlobalLimit 100" in plan


def test_keep_rows_one_for_each_key_row(spark):
    rows = [(1, "a", "x"), (1, "a", "y"), (2, "b", "z"), (None, "c", "n"), (None, "c", "m"), (3, "d", "gone")]
    df = spark.createDataFrame(rows, "id long, text string, key_id string")
    keepers = spark.createDataFrame([(1, 2), (2, 1), (None, 2)], "id long, times long")
    got = cm.keep_rows(df, keepers, {"id": F.col("id")})
    assert got.columns == df.columns
    assert Counter(tuple(r) for r in got.collect()) == Counter([(1, "a", "x"), (2, "b", "z"), (None, "c", "m")])


def test_fresh_names(spark):
    df = spark.createDataFrame([], "_ROW long, `__row` long")
    assert cm.fresh(df, "row") == "___row"


def test_shared_folder_is_the_one_the_session_names(spark):
    assert cm.shared_path(spark, "x").startswith(cm.shared_root(spark))
    assert cm.shared_path(spark, "x") != cm.shared_path(spark, "x")


class _Cluster:
    """A session's settings as a cluster without a checkpoint folder has them."""

    class sparkContext:  # noqa: N801
        master = "spark://host:7077"

        @staticmethod
        def getCheckpointDir():  # noqa: N802
            return None

    class conf:  # noqa: N801
        @staticmethod
        def get(name, default):
            return default


def test_a_cluster_without_a_shared_folder_is_an_error():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        cm.shared_root(_Cluster())
