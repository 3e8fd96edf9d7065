"""Ingest round trip over real text files: glued headers, blank lines, CRLF, short and empty files."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from fleetstops.constants import RAW_HEADER
from fleetstops.operators import ingest as ING
from fleetstops.operators.readings import dedupe_readings
from fleetstops.plans import ingestion as IN
from fleetstops.schemas import TRANSIT_STOPS, TRIPS
from fleetstops.sources.files import profile, read_csv_with_schema, read_raw_text
from fleetstops.tuning import UNTIMED_PIECES


def line(rev, t, tag, lon, lat, speed, heading, ta, pred):
    return ",".join([rev, t, tag, lon, lat, speed, heading, ta, pred])


def write(path, text, newline="\n"):
    with open(path, "w", newline="") as f:
        f.write(text.replace("\n", newline))


def make_files(root):
    d = os.path.join(root, "raw")
    os.makedirs(d)
    day1 = [
        RAW_HEADER + line("11", "01/01/2013 10:00:00", "B1", "-122.4", "37.7", "0", "90", "KT", "1"),
        "",
        line("12", "01/01/2013 10:00:30", "B1", "-122.41", "37.71", "", "", "", "1"),
        "",
        line("13", "01/01/2013 10:00:30", "B1", "-122.42", "37.72", "5.5", "180", "KT", "0"),
    ]
    day2 = [
        RAW_HEADER + line("21", "01/02/2013 08:00:00", "C2", "", "", "3", "45", "N", "1"),
        line("22", "01/02/2013 08:01:00", "C2", "-122.5", "37.8", "0", "0", "N", "1"),
    ]
    write(os.path.join(d, "positions_01012013.csv"), "\n".join(day1) + "\n")
    write(os.path.join(d, "positions_01022013.csv"), "\n".join(day2) + "\n", newline="\r\n")
    write(os.path.join(d, "positions_01032013.csv"), RAW_HEADER + "\n" + "99,short\n")
    write(os.path.join(d, "positions_01042013.csv"), "")
    return d


def test_clean_and_promote_files(spark, workdir):
    d = make_files(workdir)
    raw = read_raw_text(spark, os.path.join(d, "*.csv"))
    staging = ING.clean_raw_lines(raw)
    st = {r.rev: r for r in staging.collect()}
    # header-only line: one row with rev '' and the rest NULL; short line keeps its two fields
    assert "" in st and st[""].report_time is None and st[""].predictable is None
    assert st["99"].report_time == "short" and st["99"].vehicle_tag is None
    assert len(st) == 7 and st["11"].vehicle_tag == "B1" and st["22"].predictable == "1"  # CRLF stripped

    typed = ING.promote_readings(staging.filter(F.col("rev").isin("11", "12", "13", "21", "22")), reading_id_from="rev")
    rows = {r.reading_id: r for r in typed.collect()}
    assert rows[11].report_time == dt.datetime(2013, 1, 1, 10, 0, 0)
    assert rows[11].latitude == 37.7 and rows[11].longitude == -122.4  # names kept, no swap
    assert rows[12].speed is None and rows[12].heading is None and rows[12].train_assignment == ""
    assert rows[21].latitude is None and rows[21].longitude is None
    assert dict(typed.dtypes)["report_time"] == "timestamp_ntz"


def test_ingest_dedupes_keeping_largest_id(spark, workdir):
    d = make_files(workdir)
    raw = read_raw_text(spark, os.path.join(d, "positions_0101*.csv"))
    out = IN.ingest_avl(raw, reading_id_from="rev")
    ids = sorted(r.reading_id for r in out.collect())
    assert ids == [11, 13]  # 12 and 13 share (B1, 10:00:30): 13 stays


def test_ingest_files_with_log_records_each_file(spark, workdir):
    d = make_files(workdir)
    manifest = IN.ingest_files_with_log(
        spark,
        os.path.join(d, "positions_010[12]2013.csv"),
        os.path.join(workdir, "readings"),
        os.path.join(workdir, "manifest"),
        reading_id_from="rev",
    )
    got = {r.file_name: r.readings for r in manifest.collect()}
    path = lambda name: "file:" + os.path.join(d, name)
    assert got == {path("positions_01012013.csv"): 3, path("positions_01022013.csv"): 2}


def test_manifest_logs_files_without_readings_and_equal_names(spark, workdir):
    d = os.path.join(workdir, "raw")
    day = line("1", "01/01/2013 10:00:00", "B1", "-122.4", "37.7", "0", "90", "KT", "1") + "\n"
    for name, text in (("a/day.csv", day), ("b/day.csv", day + day.replace("10:00:00", "10:01:00")), ("b/empty.csv", ""), ("b/blank.csv", "\n\n")):
        os.makedirs(os.path.dirname(os.path.join(d, name)), exist_ok=True)
        write(os.path.join(d, name), text)
    manifest = IN.ingest_files_with_log(spark, os.path.join(d, "*", "*.csv"), os.path.join(workdir, "r"), os.path.join(workdir, "m"))
    got = {r.file_name.removeprefix("file:" + d): r.readings for r in manifest.collect()}
    assert got == {"/a/day.csv": 1, "/b/day.csv": 2, "/b/empty.csv": 0, "/b/blank.csv": 0}


def test_default_ids_are_dense_and_follow_time(spark, workdir):
    """Files whose order is not the order of time, in many partitions: ids are those of one sorted table."""
    d = os.path.join(workdir, "raw")
    os.makedirs(d)
    rnd = random.Random(4)
    rows = []
    for k in range(8):
        lines = []
        for i in range(60):
            t = dt.datetime(2013, 1, 1 + (7 - k) % 3, 10) + dt.timedelta(seconds=rnd.randrange(0, 9000))
            lines.append(line(f"{k}-{i}", t.strftime("%m/%d/%Y %H:%M:%S"), f"V{i % 5}", "-122.4", "37.7", "0", "0", "X", "1"))
            rows.append((t, f"{k}-{i}"))
        write(os.path.join(d, f"f{k}.csv"), "\n".join(lines) + "\n")
    raw = read_raw_text(spark, os.path.join(d, "*.csv")).repartition(13)
    out = IN.ingest_avl(raw, dedupe=False)
    assert {r.reading_id: r.rev for r in out.collect()} == {i + 1: rev for i, (_, rev) in enumerate(sorted(rows))}


def test_ingest_then_stops_does_not_depend_on_the_files(spark, workdir):
    from fleetstops.plans.fleet import stopped_vehicles
    from fleetstops.sources.bindings import raw_lines
    from tests.conftest import SF_SMALL

    raw = raw_lines(spark, SF_SMALL)
    want = sorted(stopped_vehicles(IN.ingest_avl(raw)).collect())
    dealt = raw.repartition(23)
    assert want and sorted(stopped_vehicles(IN.ingest_avl(dealt)).collect()) == want


def test_rejects_are_counted(spark, workdir):
    d = make_files(workdir)
    staging = ING.clean_raw_lines(read_raw_text(spark, os.path.join(d, "*.csv")))
    r = ING.count_rejects(staging, "rev").first()
    assert (r.lines, r.rejected, r.bad_report_time, r.bad_rev, r.bad_speed) == (7, 2, 1, 1, 0)


def test_default_ids_are_unique(spark, workdir):
    d = make_files(workdir)
    out = IN.ingest_files(spark, os.path.join(d, "*.csv"), dedupe=False, lenient=True)
    assert out.select("reading_id").distinct().count() == out.count() == 7


def test_csv_with_schema_and_profile(spark, workdir):
    p = os.path.join(workdir, "stops.txt")
    write(p, "stop_lat,stop_code,stop_lon,stop_url,stop_id,stop_desc,stop_name,location_type,zone_id\n"
             "37.7,1,-122.4,,100,,Main St,0,\n37.8,2,-122.5,,101,,Market St,0,\n")
    stops = read_csv_with_schema(spark, p, TRANSIT_STOPS, header=True)
    assert stops.schema == TRANSIT_STOPS
    assert sorted((r.stop_id, r.stop_lat) for r in stops.collect()) == [("100", 37.7), ("101", 37.8)]
    t = os.path.join(workdir, "trips.txt")
    write(t, "b1,r1,o1,0,h,s1,svc,t1\n")
    trips = read_csv_with_schema(spark, t, TRIPS, header=False)
    assert trips.first().trip_id == "t1"
    info = profile(stops, n=1)
    assert info["count"] == 2 and info["first"] is not None and "stop_lat:double" in info["schema"]
    assert info["partitions"] >= 1


def test_substring_helpers(spark):
    from fleetstops.functions.cleaning import drop_last_char, substring_tail

    df = spark.createDataFrame([(RAW_HEADER + "1,2",)], "value string")
    r = df.select(substring_tail("value", len(RAW_HEADER)).alias("a"), drop_last_char("value").alias("b")).first()
    assert r.a == "1,2" and r.b == RAW_HEADER + "1,"


def test_parse_report_time_keeps_wall_clock(spark):
    from fleetstops.functions.cleaning import parse_report_time

    df = spark.createDataFrame(
        [("03/10/2024 02:30:00",), ("13/45/2024 10:00:00",), ("short",), (None,), ("1/2/2024 3:04:05",), ("",)], "s string"
    )
    want = [dt.datetime(2024, 3, 10, 2, 30), None, None, None, dt.datetime(2024, 1, 2, 3, 4, 5), None]
    for tz in ("America/Los_Angeles", "UTC"):
        spark.conf.set("spark.sql.session.timeZone", tz)
        try:
            got = [r.t for r in df.select(parse_report_time("s").alias("t")).collect()]
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        assert got == want, tz


def test_parse_report_time_strict_raises(spark):
    from fleetstops.functions.cleaning import parse_report_time_strict

    for text in ("13/45/2024 10:00:00", "", "short"):
        with pytest.raises(Exception, match="malformed report time"):
            spark.createDataFrame([(text,)], "s string").select(parse_report_time_strict("s")).collect()
    good = spark.createDataFrame([("1/2/2024 3:04:05",), (None,)], "s string").select(parse_report_time_strict("s").alias("t"))
    assert [r.t for r in good.collect()] == [dt.datetime(2024, 1, 2, 3, 4, 5), None]


def test_assign_reading_id(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(str(i), t0 + dt.timedelta(seconds=i * 37 % 300 * 1000) if i % 9 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "x string, report_time timestamp_ntz").repartition(5)
    # Rows without a time: by the hash of their columns, then by the columns.
    place = {r.x: r.h for r in df.select("x", F.pmod(F.xxhash64("x", "report_time"), F.lit(UNTIMED_PIECES)).alias("h")).collect()}
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or t0, 0 if r[1] else place[r[0]], r[0]))
    got = {r.reading_id: r.x for r in ING.assign_reading_id(df).collect()}
    assert got == {i + 1: r[0] for i, r in enumerate(want)}
    assert ING.assign_reading_id(df, "x").filter("reading_id = 77").first().x == "77"
    odd = spark.createDataFrame([("7",), ("x7",)], "x string")
    with pytest.raises(Exception):
        ING.assign_reading_id(odd, "x").collect()
    assert sorted((r.reading_id or 0) for r in ING.assign_reading_id(odd, "x", lenient=True).collect()) == [0, 7]


def test_gzip_file_is_spread_after_reading(spark, workdir):
    import gzip

    p = os.path.join(workdir, "big.csv.gz")
    with gzip.open(p, "wt") as f:
        for i in range(2000):
            f.write(f"{i},01/01/2013 10:00:{i % 60:02d},V{i % 7},-122.4,37.7,0,0,X,1\n")
    raw = read_raw_text(spark, p)
    assert raw.rdd.getNumPartitions() == 1  # not splittable
    spread = read_raw_text(spark, p, spread=8)
    assert spread.rdd.getNumPartitions() == 8 and spread.count() == 2000
    assert IN.ingest_avl(spread, reading_id_from="rev", dedupe=False).count() == 2000


def test_malformed_numbers_strict_and_lenient(spark):
    bad = spark.createDataFrame([("1,01/01/2013 10:00:00,B1,-122.4,37.7,fast,0,X,1",)], "value string")
    with pytest.raises(Exception):
        IN.ingest_avl(bad, reading_id_from="rev").collect()
    row = IN.ingest_avl(bad, reading_id_from="rev", lenient=True).first()
    assert row.speed is None and row.latitude == 37.7


def test_rows_without_a_time_are_dealt_over_pieces(spark):
    """Ids stay dense and follow from the content alone; rows without a time come first and not in one task."""
    rows = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN timestamp_ntz'2013-01-01 10:00:00' END AS report_time", "id % 1400 AS v", "'x' AS same")
    got = [tuple(r) for r in ING.time_ordered_ids(rows).orderBy("reading_id").collect()]
    assert [r[0] for r in got] == list(range(1, 3001))
    assert [r[1] is None for r in got] == [True] * 2000 + [False] * 1000
    again = [tuple(r) for r in ING.time_ordered_ids(rows.repartition(7)).orderBy("reading_id").collect()]
    assert got == again
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    untimed = ING.time_ordered_ids(rows.filter("report_time IS NULL"))
    try:
        assert untimed.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_dedupe_of_a_hot_key(spark):
    rows = spark.range(4000).selectExpr("IF(id % 4 < 3, 'A', NULL) AS vehicle_tag", "timestamp_ntz'2013-01-01 10:00:00' AS report_time",
                                        "IF(id % 8 = 0, NULL, id DIV 2) AS reading_id", "id AS speed")
    got = dedupe_readings(rows)
    assert got.columns == rows.columns
    hot = got.filter("vehicle_tag = 'A'").collect()
    assert [(r.reading_id, r.speed) for r in hot] == [(1999, 3998)]
    assert got.filter("vehicle_tag IS NULL").count() == 1000
