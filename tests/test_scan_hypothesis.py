"""Generated histories (Hypothesis): the chunked scan equals the brute-force definitions.

Few examples (each one runs Spark jobs), but every example mixes vehicles,
shared report times, NULL speeds and a random chunk length.
"""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from fleetstops.operators import stops as ST
from tests.test_window_vs_join import SCHEMA, brute_last_moving

T0 = dt.datetime(2024, 1, 1)

reading = st.tuples(
    st.sampled_from(["a", "b", "c"]),
    st.integers(min_value=0, max_value=400),  # seconds after T0 (repeats make shared times)
    st.one_of(st.none(), st.sampled_from([0.0, 0.0, 2.5, 7.0])),
)


def _rows(raw, shuffle_ids):
    seen, rows = set(), []
    for v, s, sp in raw:
        if (v, s) in seen:  # unique (vehicle, time): the condition the window form relies on
            continue
        seen.add((v, s))
        rows.append((v, T0 + dt.timedelta(seconds=s), sp))
    rows.sort(key=lambda r: (r[1], r[0]))
    ids = list(range(1, len(rows) + 1))
    if shuffle_ids:
        ids = ids[::-1]
    return [(i, v, t, sp) for i, (v, t, sp) in zip(ids, rows)]


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    raw=st.lists(reading, min_size=1, max_size=60),
    chunk=st.sampled_from([1, 7, 45, 1000, 86_400]),
    gap=st.sampled_from([None, 3, 10, 300]),
    shuffle_ids=st.booleans(),
)
def test_scan_matches_definitions(spark, raw, chunk, gap, shuffle_ids):
    rows = _rows(raw, shuffle_ids)
    df = spark.createDataFrame(rows, SCHEMA)
    # next speed: the speed of the next reading of the same vehicle in time order
    by_v = {}
    for r in rows:
        by_v.setdefault(r[1], []).append(r)
    want_next = {}
    for rs in by_v.values():
        rs.sort(key=lambda r: r[2])
        for i, r in enumerate(rs):
            want_next[r[0]] = rs[i + 1][3] if i + 1 < len(rs) else None
    got_next = {r.reading_id: r.next_speed for r in ST.next_speed(df, chunk_seconds=chunk).collect()}
    assert got_next == want_next
    # stop ends with the latest earlier moving reading (optionally id-bounded), exact form
    ends = [r for r in rows if r[3] == 0.0 and (want_next[r[0]] or 0) > 0]
    want = brute_last_moving(rows, ends, gap)
    got = {
        (r.vehicle_tag, r.report_time): r.last_moving_time
        for r in ST.stop_ends_with_last_moving(df, max_id_gap=gap, chunk_seconds=chunk).collect()
    }
    assert got == want
