"""Plan-shape checks: the properties that matter at scale stay true as the code changes.

* filters and column pruning reach the Parquet scan;
* the scan reads and shuffles the readings once, by (vehicle, chunk);
* building a question starts no job;
* stop lengths are positive and there is one row per (vehicle, stop end).
"""

import re

import pytest
from pyspark.sql import functions as F

from fleetstops.operators import scan as S
from fleetstops.operators.readings import between_times
from fleetstops.registry import QUERIES
from fleetstops.registry_batches import QUERIES as BATCH_QUERIES
from fleetstops.sources import bindings
from fleetstops.sources.bindings import readings
from tests.conftest import SF_MID, SF_SMALL


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(plan):
    return re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition)\(?([^,\]]*)", plan)


def ran(df):
    """The plan that ran, after its rows were taken."""
    df.collect()
    return plan_of(df).split("== Initial Plan ==")[0]


def test_scan_pushes_filters_and_prunes_columns(spark):
    r = between_times(readings(spark, SF_MID), "2024-01-05 00:00:00", "2024-01-20 00:00:00")
    plan = plan_of(S.history_scan(r.select("reading_id", "vehicle_tag", "report_time", "speed")))
    assert re.search(r"PushedFilters: \[[^\]]*GreaterThanOrEqual\(ts,2024-01-05[^\]]*LessThanOrEqual\(ts,2024-01-20", plan)
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert sorted(f.split(":")[0] for f in schema.split(",")) == ["event_id", "event_type", "ts", "user_id", "value"]


@pytest.mark.parametrize("question", ["stopped_vehicles", "stops_detail", "stop_times", "next_speed", "last_moving_window", "list_stopped_vehicles", "ids_follow_time"])
def test_readings_are_read_and_shuffled_once(spark, question):
    """Both uses of the (vehicle, chunk) shuffle are one exchange over one scan of the source."""
    plan = ran(QUERIES[question](spark, SF_MID))
    assert len(re.findall("FileScan", plan)) == 1
    assert len(re.findall(r"(?<!\], )Exchange hashpartitioning\(_fs_part#\d+, \d+\), REPARTITION_BY_COL", plan)) == 1
    assert "ReusedExchange" in plan


def test_window_and_join_share_the_deal(spark):
    r = readings(spark, SF_MID).select("reading_id", "vehicle_tag", "report_time", "speed")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # force the sort-merge form to inspect it
    try:
        plan = plan_of(S.history_scan(r, keep=S.stop_end_candidates()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Between the join and the in-piece window: no exchange and no sort (the window's order already satisfies the join).
    between = plan.split("SortMergeJoin", 1)[1].split("Window [", 1)[0]
    assert "Exchange" not in between and "Sort [" not in between


@pytest.mark.parametrize("question", sorted(QUERIES))
def test_building_a_question_starts_no_job(spark, question, monkeypatch):
    """Nothing runs before the action, apart from reading a table's Parquet footer when it is opened."""
    opened = {n: spark.read.parquet(f"{SF_SMALL}/{n}.parquet") for n in ("events", "supplier", "orders")}
    monkeypatch.setattr(bindings, "table", lambda _spark, _dir, name: opened[name])
    sc = spark.sparkContext
    group = f"build-{question}"
    sc.setJobGroup(group, "plan building")
    try:
        QUERIES[question](spark, SF_SMALL)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    jobs = sc.statusTracker().getJobIdsForGroup(group)
    assert bool(jobs) == (question in RUNS_WHEN_BUILT)


#: Places and comparisons by position fix the order of their rows first; a keyed comparison checks that its key is unique;
#: tables that are kept batch by batch take their batches.
RUNS_WHEN_BUILT = {"content_diff_ordered", "approx_diff", "approx_diff_special", "diff_with", "default_sort", "stop_order", "hour_order", *BATCH_QUERIES}


def test_stop_times_properties(spark):
    from fleetstops.plans.fleet import stop_times

    st = stop_times(readings(spark, SF_MID))
    assert st.filter(F.col("stopped_for") <= 0).count() == 0
    assert st.groupBy("vehicle_tag", "stopped_at").count().filter("count > 1").count() == 0
    assert st.filter(F.col("stopped_since") >= F.col("stopped_at")).count() == 0


def test_dedupe_combines_before_its_one_shuffle(spark):
    plan = plan_of(QUERIES["dedupe_readings"](spark, SF_MID))
    assert plan.count("Exchange") == 1 and "partial_max" in plan.split("Exchange", 1)[1] and "Window" not in plan


def test_recommended_conf_scales_shuffle_partitions():
    from fleetstops.session import recommended_conf

    small = recommended_conf(10 * 1024**3, 8)
    big = recommended_conf(100 * 1024**4, 8000)
    assert int(small["spark.sql.shuffle.partitions"]) == 40
    assert int(big["spark.sql.shuffle.partitions"]) == 416000 and int(big["spark.sql.shuffle.partitions"]) % 8000 == 0


def test_scan_deals_vehicle_partitioned_input_anew(spark):
    """An input already hash-partitioned by vehicle must not stand in for the (vehicle, chunk) split."""
    r = readings(spark, SF_MID).select("reading_id", "vehicle_tag", "report_time", "speed").repartition(16, "vehicle_tag")
    plan = plan_of(S.history_scan(r, chunk_seconds=3600, keep=S.stop_end_candidates()))
    assert re.search(r"(?<!\], )Exchange hashpartitioning\(_fs_part", plan.split("Window [", 1)[1])
