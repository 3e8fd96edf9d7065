"""Property tests: the chunked window forms against brute force on random readings.

Random readings have unique (vehicle, time) keys, NULL speeds, several vehicles
of very different sizes (one holding most rows), and small chunk lengths so
that most stops cross chunk borders. The brute force is the join form computed
in plain Python on the collected fixture (small by construction).
"""

import datetime as dt
import random

import pytest
from pyspark.sql import types as T

from fleetstops.operators import readings as RD
from fleetstops.operators import stops as ST

SCHEMA = T.StructType(
    [
        T.StructField("reading_id", T.LongType(), False),
        T.StructField("vehicle_tag", T.StringType()),
        T.StructField("report_time", T.TimestampNTZType()),
        T.StructField("speed", T.DoubleType()),
    ]
)
T0 = dt.datetime(2024, 1, 1)


def make_rows(seed, n=600, ids_follow_time=True):
    rnd = random.Random(seed)
    rows, used = [], set()
    vehicles = ["hot"] * 6 + ["a", "b", "c", None]
    for _ in range(n):
        v = rnd.choice(vehicles)
        while True:
            t = T0 + dt.timedelta(seconds=rnd.randrange(0, 6 * 3600), microseconds=rnd.choice([0, 250000, 999999]))
            if (v, t) not in used:
                used.add((v, t))
                break
        s = rnd.choice([0.0, 0.0, 0.0, 3.5, 12.0, None])
        rows.append([v, t, s])
    rows.sort(key=lambda r: (r[1], str(r[0])))
    ids = list(range(1, len(rows) + 1))
    if not ids_follow_time:
        rnd.shuffle(ids)
    return [(i * 7, v, t, s) for i, (v, t, s) in zip(ids, rows)]


def brute_next_speed(rows):
    out = {}
    by_v = {}
    for r in rows:
        by_v.setdefault(r[1], []).append(r)
    for v, rs in by_v.items():
        rs.sort(key=lambda r: r[2])
        for i, r in enumerate(rs):
            out[r[0]] = rs[i + 1][3] if i + 1 < len(rs) else None
    return out


def brute_last_moving(rows, queries, gap):
    """Join form: max(moving.time) over same vehicle, earlier, id gap < gap (None = no gap)."""
    res = {}
    for q in queries:
        best = None
        for m in rows:
            if m[1] is None or q[1] is None or m[1] != q[1] or not (m[3] is not None and m[3] > 0):
                continue
            if not (q[2] > m[2]):
                continue
            if gap is not None and not (q[0] - m[0] < gap):
                continue
            best = m[2] if best is None or m[2] > best else best
        if best is not None:
            res[(q[1], q[2])] = best
    return res


@pytest.mark.parametrize("seed,chunk", [(1, 60), (2, 600), (3, 7), (4, 3600)])
def test_next_speed_matches_lead_over_whole_vehicle(spark, seed, chunk):
    rows = make_rows(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.reading_id: r.next_speed for r in ST.next_speed(df, chunk_seconds=chunk).collect()}
    assert got == brute_next_speed(rows)


@pytest.mark.parametrize("seed,chunk", [(5, 60), (6, 900), (7, 13)])
def test_unbounded_last_moving_matches_join(spark, seed, chunk):
    rows = make_rows(seed, ids_follow_time=False)
    df = spark.createDataFrame(rows, SCHEMA)
    stopped = [r for r in rows if r[3] == 0.0]
    got = {
        (r.vehicle_tag, r.report_time): r.last_moving_time
        for r in ST.last_moving_time_unbounded(ST.filter_stopped(df), ST.filter_moving(df), chunk_seconds=chunk).collect()
    }
    assert got == brute_last_moving(rows, stopped, None)


@pytest.mark.parametrize("seed,chunk,gap", [(8, 60, 300), (9, 600, 70), (10, 30, 2000)])
def test_gap_bounded_last_moving_matches_join_when_ids_follow_time(spark, seed, chunk, gap):
    rows = make_rows(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    check = RD.ids_follow_time(df, chunk_seconds=chunk).first()
    assert check.violations == 0 and check.tied_times == 0
    ends = ST.find_last_stopped(df, chunk_seconds=chunk)
    end_rows = [(r.reading_id, r.vehicle_tag, r.report_time, r.speed) for r in ends.collect()]
    got = {
        (r.vehicle_tag, r.report_time): r.last_moving_time
        for r in ST.last_moving_time(ends, ST.filter_moving(df), max_id_gap=gap, chunk_seconds=chunk).collect()
    }
    assert got == brute_last_moving(rows, end_rows, gap)
    fused = {
        (r.vehicle_tag, r.report_time): r.last_moving_time
        for r in ST.stop_ends_with_last_moving(df, max_id_gap=gap, chunk_seconds=chunk).collect()
    }
    assert fused == got


def test_ids_follow_time_detects_shuffled_ids(spark):
    df = spark.createDataFrame(make_rows(11, ids_follow_time=False), SCHEMA)
    assert RD.ids_follow_time(df, chunk_seconds=60).first().violations > 0


def test_gap_bounded_flags_only_undecidable_rows(spark):
    """With shuffled ids every row the window form keeps is right, and every row it
    cannot decide is flagged ``ambiguous`` (never silently dropped)."""
    rows = make_rows(12, ids_follow_time=False)
    df = spark.createDataFrame(rows, SCHEMA)
    out = ST.stop_ends_with_last_moving(df, max_id_gap=3000, chunk_seconds=60, with_ambiguous=True).collect()
    ends = [(r.reading_id, r.vehicle_tag, r.report_time, r.speed) for r in out]
    want = brute_last_moving(rows, ends, 3000)
    for r in out:
        key = (r.vehicle_tag, r.report_time)
        if not r.ambiguous:
            assert want.get(key) == r.last_moving_time
    all_ends = [
        (r.reading_id, r.vehicle_tag, r.report_time, r.speed)
        for r in ST.find_last_stopped(df, chunk_seconds=60).collect()
    ]
    decided = {(r.vehicle_tag, r.report_time) for r in out}
    for key in brute_last_moving(rows, all_ends, 3000):
        assert key in decided


def test_dedupe_keeps_largest_id(spark):
    rows = [
        (1, "v", T0, 1.0),
        (5, "v", T0, 2.0),
        (3, "v", T0, 3.0),
        (2, "w", T0, 4.0),
        (4, "v", T0 + dt.timedelta(seconds=1), 5.0),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    out = sorted(tuple(r) for r in RD.dedupe_readings(df).collect())
    assert out == sorted([(5, "v", T0, 2.0), (2, "w", T0, 4.0), (4, "v", T0 + dt.timedelta(seconds=1), 5.0)])
    assert RD.dedupe_readings(RD.dedupe_readings(df)).count() == 3
    assert sorted(tuple(r) for r in RD.duplicate_keys(df).collect()) == [("v", T0, 3)]
    # rows with a NULL key part are never duplicates of each other
    nulls = spark.createDataFrame([(7, None, T0, 1.0), (8, None, T0, 2.0), (9, "v", None, 3.0)], SCHEMA)
    assert RD.dedupe_readings(nulls).count() == 3


@pytest.mark.parametrize("seed,chunk,gap", [(13, 60, 3000), (14, 900, 800), (15, 20, 200)])
def test_gap_bounded_is_exact_when_ids_do_not_follow_time(spark, seed, chunk, gap):
    """Shuffled ids: undecided rows are answered by the id-block scan; the result equals the join form."""
    rows = make_rows(seed, ids_follow_time=False)
    df = spark.createDataFrame(rows, SCHEMA)
    undecided = ST.stop_ends_with_last_moving(df, max_id_gap=gap, chunk_seconds=chunk, with_ambiguous=True)
    assert undecided.filter("ambiguous").count() > 0  # the case is really exercised
    ends = ST.find_last_stopped(df, chunk_seconds=chunk)
    end_rows = [(r.reading_id, r.vehicle_tag, r.report_time, r.speed) for r in ends.collect()]
    want = brute_last_moving(rows, end_rows, gap)
    got = {
        (r.vehicle_tag, r.report_time): r.last_moving_time
        for r in ST.last_moving_time(ends, ST.filter_moving(df), max_id_gap=gap, chunk_seconds=chunk).collect()
    }
    assert got == want
    fused = {
        (r.vehicle_tag, r.report_time): r.last_moving_time
        for r in ST.stop_ends_with_last_moving(df, max_id_gap=gap, chunk_seconds=chunk).collect()
    }
    assert fused == want


@pytest.mark.parametrize("chunk", [60, 3600, 86_400])
def test_any_chunk_length_gives_the_same_answers(spark, chunk):
    """The split changes cost, never results, also with one vehicle that holds most readings."""
    rows = make_rows(16, n=3000)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {
        (r.vehicle_tag, r.report_time): r.last_moving_time
        for r in ST.stop_ends_with_last_moving(df, max_id_gap=None, chunk_seconds=chunk).collect()
    }
    ends = [(r.reading_id, r.vehicle_tag, r.report_time, r.speed) for r in ST.find_last_stopped(df).collect()]
    assert got == brute_last_moving(rows, ends, None)


@pytest.mark.parametrize("seed,gap,max_s,shift", [(17, 1500, 900, 0), (18, 3000, 300, -10_000), (19, 300, 7200, 0)])
def test_open_rows_within_a_stop_length_limit(spark, seed, gap, max_s, shift):
    """With a limit on the stop length, open rows are answered from two chunks; every younger answer is found."""
    rows = [(r[0] + shift, *r[1:]) for r in make_rows(seed, ids_follow_time=False)]
    df = spark.createDataFrame(rows, SCHEMA)
    ends = [(r.reading_id, r.vehicle_tag, r.report_time, r.speed) for r in ST.find_last_stopped(df).collect()]
    want = {k: t for k, t in brute_last_moving(rows, ends, gap).items() if (k[1] - t).total_seconds() < max_s}
    for chunk in (max_s, 86_400):
        got = {
            (r.vehicle_tag, r.report_time): r.last_moving_time
            for r in ST.stop_ends_with_last_moving(df, max_id_gap=gap, max_s=max_s, chunk_seconds=chunk).collect()
        }
        assert {k: t for k, t in got.items() if (k[1] - t).total_seconds() < max_s} == want


def test_ids_may_be_negative(spark):
    rows = [(r[0] - 2_000, *r[1:]) for r in make_rows(20, ids_follow_time=False)]
    df = spark.createDataFrame(rows, SCHEMA)
    ends = [(r.reading_id, r.vehicle_tag, r.report_time, r.speed) for r in ST.find_last_stopped(df).collect()]
    got = {(r.vehicle_tag, r.report_time): r.last_moving_time for r in ST.stop_ends_with_last_moving(df, max_id_gap=800).collect()}
    assert got == brute_last_moving(rows, ends, 800)


def test_rows_without_vehicle_or_time_stay(spark):
    """A window keeps rows without key or time; a join on the key drops them."""
    t = [T0 + dt.timedelta(seconds=60 * i) for i in range(4)]
    rows = [(1, None, t[0], 0.0), (2, None, t[1], 5.0), (3, "v", None, 0.0), (4, "v", t[0], 3.0), (5, "v", t[2], 0.0), (6, "v", t[3], 2.0), (7, None, None, 4.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.reading_id: r.next_speed for r in ST.next_speed(df).collect()} == {7: 0.0, 1: 5.0, 2: None, 3: 3.0, 4: 0.0, 5: 2.0, 6: None}
    assert sorted(r.reading_id for r in ST.find_last_stopped(df).collect()) == [1, 3, 5]
    assert {r.reading_id: r.last_moving_time for r in ST.last_moving_window(df).collect()} == {1: None, 3: None, 5: t[0]}
    assert [r.reading_id for r in ST.stop_ends_with_last_moving(df, max_id_gap=None).collect()] == [5]
    assert [r.report_time for r in ST.last_moving_time(ST.filter_stopped(df), ST.filter_moving(df)).collect()] == [t[2]]
