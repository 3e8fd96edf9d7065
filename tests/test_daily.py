"""Stop tables kept batch by batch against one pass over all readings."""

import datetime as dt
import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from fleetstops.plans.daily import add_batch, carried, stop_table
from fleetstops.plans.fleet import stop_times, stops_detail

SCHEMA = "reading_id long, vehicle_tag string, report_time timestamp_ntz, speed double, latitude double, longitude double"
T0 = dt.datetime(2024, 1, 1)


def counted(df, columns=None):
    return Counter(map(tuple, (df.select(*columns) if columns else df).collect()))


def in_batches(spark, rows, cuts, root, **how):
    """Rows dealt into batches at the cut times; the tables' folder."""
    edges, after = [dt.datetime.min, *cuts, dt.datetime.max], None
    for k in range(len(edges) - 1):
        part = [r for r in rows if r[2] is not None and edges[k] <= r[2] < edges[k + 1]]
        add_batch(spark, spark.createDataFrame(part, SCHEMA), root, f"b{k}", after, **how)
        after = f"b{k}"
    return root


def check(spark, rows, cuts, root, **how):
    in_batches(spark, rows, cuts, root, **how)
    one = spark.createDataFrame(rows, SCHEMA)
    assert counted(stop_table(spark, root, "stop_times")) == counted(stop_times(one, with_location=True))
    detail = stops_detail(one, **how)
    assert counted(stop_table(spark, root, "stops_detail"), detail.columns) == counted(detail)


def readings(seed, n, vehicles, days, shuffled_ids):
    rng = random.Random(seed)
    times = sorted(rng.sample(range(days * 86_400), n))
    ids = list(range(n))
    if shuffled_ids:
        for k in range(0, n, 7):
            ids[k : k + 7] = reversed(ids[k : k + 7])
    return [(ids[k], f"v{rng.randrange(vehicles)}", T0 + dt.timedelta(seconds=t), rng.choice([0.0, 0.0, 3.0, None]), 37 + k / 1e4, -122.0) for k, t in enumerate(times)]


@pytest.mark.parametrize(("seed", "shuffled"), [(1, False), (2, True)])
def test_batches_equal_one_pass(spark, workdir, seed, shuffled):
    rows = readings(seed, 700, 5, 4, shuffled)
    rows += [(10_000, None, T0, 0.0, 1.0, 1.0), (10_001, "v0", None, 4.0, 1.0, 1.0)]
    # A vehicle that stands for days, and one that comes late.
    rows += [(20_000, "park", T0, 5.0, 1.0, 1.0), (20_001, "park", T0 + dt.timedelta(hours=1), 0.0, 2.0, 2.0), (20_900, "park", T0 + dt.timedelta(days=3), 9.0, 3.0, 3.0)]
    rows += [(30_000, "late", T0 + dt.timedelta(days=3, hours=5), 1.0, 1.0, 1.0)]
    cuts = [T0 + dt.timedelta(hours=h) for h in (20, 47.5, 48, 80)]
    check(spark, rows, cuts, workdir, max_id_gap=6 if shuffled else 300)


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 2), st.sampled_from([0.0, 2.0, None])), max_size=40, unique_by=lambda r: r[:2]), st.randoms(use_true_random=False), st.lists(st.integers(0, 30), min_size=1, max_size=3, unique=True))
def test_small_histories(spark, tmp_path_factory, points, rng, cuts):
    ids = list(range(len(points)))
    rng.shuffle(ids)
    rows = [(i, f"v{v}", T0 + dt.timedelta(minutes=7 * m), s, float(i), 0.0) for i, (m, v, s) in zip(ids, points, strict=True)]
    check(spark, rows, [T0 + dt.timedelta(minutes=7 * c) for c in sorted(cuts)], str(tmp_path_factory.mktemp("d")), max_id_gap=4, min_s=60, max_s=3600)


def test_a_batch_run_again_changes_nothing(spark, workdir):
    rows = readings(3, 300, 3, 3, False)
    cuts = [T0 + dt.timedelta(days=1), T0 + dt.timedelta(days=2)]
    in_batches(spark, rows, cuts, workdir)
    before = counted(stop_table(spark, workdir, "stop_times"))
    part = [r for r in rows if cuts[0] <= r[2] < cuts[1]]
    add_batch(spark, spark.createDataFrame(part, SCHEMA), workdir, "b1", "b0")
    assert counted(stop_table(spark, workdir, "stop_times")) == before


def test_late_readings_are_refused(spark, workdir):
    rows = readings(4, 100, 2, 2, False)
    in_batches(spark, rows, [T0 + dt.timedelta(days=1)], workdir)
    with pytest.raises(ValueError, match="not after"):
        add_batch(spark, spark.createDataFrame([rows[10]], SCHEMA), workdir, "b2", "b1")
    with pytest.raises(ValueError, match="no stop table"):
        stop_table(spark, workdir, "other")


def test_carry_is_small_and_moves_by_vehicle_and_stretch(spark):
    """Of a dense history the carry keeps two hours a vehicle; its join key is not the vehicle alone."""
    rows = [(k, "hot" if k % 3 else f"v{k % 5}", T0 + dt.timedelta(seconds=20 * k), 3.0 if k % 2 else 0.0, 1.0, 1.0) for k in range(20_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = carried(df)
    last = T0 + dt.timedelta(seconds=20 * 19_999)
    kept = got.collect()
    assert len(kept) < 400 and sum(r.last for r in kept) == 6
    assert all(r.last or r.speed > 0 and r.report_time >= last - dt.timedelta(hours=2, minutes=5) for r in kept)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "[_v#" in plan and "_s0#" in plan.split("Join")[1].splitlines()[0]


def test_jobs_from_the_command_line(spark, workdir):
    """The daily and the upsert job over a stored readings table, batch after batch."""
    from fleetstops.plans.jobs import main
    from fleetstops.plans.upsert import distinct_list, readings_table
    from fleetstops.sources import bindings as B

    from .conftest import SF_SMALL

    readings = B.readings(spark, SF_SMALL)
    source, cut = f"{workdir}/readings", "2024-01-16 00:00:00"
    readings.write.parquet(source)
    main(["daily", f"parquet:{source}", f"{workdir}/stops", "a", "--upper", cut])
    main(["daily", f"parquet:{source}", f"{workdir}/stops", "b", "--after", "a", "--lower", cut])
    assert counted(stop_table(spark, f"{workdir}/stops", "stop_times")) == counted(stop_times(readings, with_location=True))
    for _ in range(2):
        main(["upsert", f"parquet:{source}", f"{workdir}/table", "all"])
    assert readings_table(spark, f"{workdir}/table").count() == readings.count()
    assert distinct_list(spark, f"{workdir}/table", "vehicle_tag").count() == readings.select("vehicle_tag").distinct().count()
