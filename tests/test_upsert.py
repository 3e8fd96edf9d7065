"""A readings table kept without duplicates batch by batch, against one pass; failures half way; counts of values."""

import datetime as dt
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fleetstops.operators.readings import dedupe_readings
from fleetstops.plans import upsert as U
from fleetstops.session import list_path

SCHEMA = "reading_id long, vehicle_tag string, report_time timestamp_ntz, speed double, train_assignment string"
T0 = dt.datetime(2024, 1, 1)
HOW = {"buckets": 2}


def make(seed, n, days=4):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        vehicle = None if k % 41 == 0 else f"v{rng.randrange(4)}"
        time = None if k % 53 == 1 else T0 + dt.timedelta(hours=rng.randrange(24 * days))
        rows.append((k, vehicle, time, float(k % 7), f"line {k % 29}" if k % 3 else None))
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def table(spark, root):
    return Counter(map(tuple, U.readings_table(spark, root).select(*(f.split()[0] for f in SCHEMA.split(", "))).collect()))


def one_pass(spark, rows):
    return Counter(map(tuple, dedupe_readings(frame(spark, rows)).collect()))


def values(spark, root):
    return {(r["column"], r["value"]): r["rows"] for r in U.refresh_values(spark, root).collect()}


def counted(rows):
    return dict(Counter(("vehicle_tag", r[1]) for r in rows.elements()) + Counter(("train_assignment", r[4]) for r in rows.elements()))


def test_batches_equal_one_pass_and_refreshes_follow(spark, workdir):
    rows = make(1, 500)
    root, done = workdir + "/t", []
    for k in range(3):
        part = rows[k::3]
        assert U.upsert_batch(spark, frame(spark, part), root, f"b{k}", **HOW)
        done += part
        assert table(spark, root) == one_pass(spark, done)
        if k != 1:  # a refresh may take several batches at once
            assert values(spark, root) == counted(table(spark, root))
    # Again under its name, and its keyed rows under another name: nothing changes.
    before = table(spark, root)
    assert not U.upsert_batch(spark, frame(spark, rows[1::3]), root, "b1", **HOW)
    keyed = [r for r in rows[0::3] if r[1] is not None and r[2] is not None]
    assert U.upsert_batch(spark, frame(spark, keyed), root, "again", **HOW)
    assert table(spark, root) == before and values(spark, root) == counted(before)
    assert list_path(spark, root + "/_pending") == list_path(spark, root + "/_new") == []


def test_a_value_that_goes_leaves_the_list(spark, workdir):
    root = workdir + "/t"
    U.upsert_batch(spark, frame(spark, [(1, "a", T0, 0.0, "old line"), (2, "b", T0, 0.0, "N")]), root, "b0", **HOW)
    assert sorted(r[0] for r in U.distinct_list(spark, root, "train_assignment").collect()) == ["N", "old line"]
    U.upsert_batch(spark, frame(spark, [(3, "a", T0, 1.0, "N")]), root, "b1", **HOW)
    assert [r[0] for r in U.distinct_list(spark, root, "train_assignment").collect()] == ["N"]
    assert sorted(r[0] for r in U.distinct_list(spark, root, "vehicle_tag").collect()) == ["a", "b"]


@pytest.mark.parametrize("step", ["merged", "changes", "applied", "clearing"])
def test_a_batch_that_failed_is_finished_by_the_next_call(spark, workdir, monkeypatch, step):
    """Whatever step fails, the next call (of another batch, then of this one) leaves what one pass gives."""
    rows, root = make(2, 240), workdir + "/t"
    U.upsert_batch(spark, frame(spark, rows[0::3]), root, "b0", **HOW)

    def fail(*_a, **_b):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        if step == "merged":
            m.setattr(U, "_count_changes", fail)
        elif step == "changes":
            m.setattr(U, "_apply", fail)
        elif step == "applied":
            m.setattr(U, "_done", lambda s, r, kind, real=U._done, seen=[]: fail() if kind == "_applied" and (seen.append(1) or len(seen) > 1) else real(s, r, kind))
        else:
            m.setattr(U, "delete_path", lambda s, p, real=U.delete_path: fail() if "_pending" in p else real(s, p))
        with pytest.raises(RuntimeError, match="lost"):
            U.upsert_batch(spark, frame(spark, rows[1::3]), root, "b1", **HOW)
    U.upsert_batch(spark, frame(spark, rows[2::3]), root, "b2", **HOW)
    U.upsert_batch(spark, frame(spark, rows[1::3]), root, "b1", **HOW)
    assert table(spark, root) == one_pass(spark, rows)
    assert values(spark, root) == counted(table(spark, root))


def test_untouched_parts_are_neither_read_nor_written(spark, workdir):
    root = workdir + "/t"
    U.upsert_batch(spark, frame(spark, [r for r in make(3, 400) if r[1] and r[2]]), root, "b0", **HOW)
    files = {p: list_path(spark, f"{root}/data/{p}") for p in list_path(spark, root + "/data") if p.startswith("_period")}
    parts = {p: {b: list_path(spark, f"{root}/data/{p}/{b}") for b in inner} for p, inner in files.items()}
    late = (10_000, "v1", T0 + dt.timedelta(hours=30), 5.0, "late")
    U.upsert_batch(spark, frame(spark, [late]), root, "b1", **HOW)
    now = {p: {b: list_path(spark, f"{root}/data/{p}/{b}") for b in inner} for p, inner in files.items()}
    changed = [(p, b) for p in parts for b in parts[p] if parts[p][b] != now[p][b]]
    assert len(changed) == 1 and changed[0][0] == "_period=2024010200"
    new = U.place(frame(spark, [late]), "day", 2, "vehicle_tag", "report_time").withColumn(U.BATCH, F.lit("b2"))
    there = U.touched_parts(new, root)
    plan = there._jdf.queryExecution().executedPlan().toString()
    filters = re.search(r"PartitionFilters: \[([^\]]*)\]", plan).group(1)
    assert "_period" in filters and "2024010200" in filters and "_bucket" in filters
    assert {r.report_time.date() for r in there.collect()} == {dt.date(2024, 1, 2)}


def test_empty_batch_and_empty_table(spark, workdir):
    root = workdir + "/t"
    assert U.refresh_values(spark, root).count() == 0
    assert U.upsert_batch(spark, frame(spark, []), root, "b0", **HOW)
    assert U.upsert_batch(spark, frame(spark, [(1, "a", T0, 0.0, "N")]), root, "b1", **HOW)
    assert U.upsert_batch(spark, frame(spark, []), root, "b2", **HOW)
    assert sum(table(spark, root).values()) == 1 and values(spark, root) == {("vehicle_tag", "a"): 1, ("train_assignment", "N"): 1}
