"""The readings table's layout: rows that a scan hands on for one vehicle and for one hour, against the plain layout."""

from pyspark.sql import functions as F

from fleetstops.sources import bindings as B
from fleetstops.sources.tables import read_readings, write_readings

SF = "/root/testdata/sf0.01"


def _scanned(df) -> int:
    """Rows of the row groups that the scan did not skip."""
    plan = df.select("*")._jdf.queryExecution().executedPlan()  # a new plan: metrics add up over runs
    plan.executeCollect()
    return plan.collectLeaves().head().metrics().apply("numOutputRows").value()


def test_one_vehicle_and_one_hour_skip(spark, tmp_path):
    readings = B.readings(spark, SF)
    plain, laid = str(tmp_path / "plain"), str(tmp_path / "laid")
    readings.repartition(64).write.parquet(plain)
    write_readings(readings, laid, files=64)
    total = readings.count()
    vehicle = readings.groupBy("vehicle_tag").count().orderBy(F.desc("count"), "vehicle_tag").first()["vehicle_tag"]
    hour = "report_time >= TIMESTAMP_NTZ'2024-01-10 05:00:00' AND report_time < TIMESTAMP_NTZ'2024-01-10 06:00:00'"
    cases = [
        (F.col("vehicle_tag") == vehicle, read_readings(spark, laid).filter(F.col("vehicle_tag") == vehicle)),
        (F.expr(hour), read_readings(spark, laid, "2024-01-10 05:00:00", "2024-01-10 06:00:00")),
    ]
    for wanted, b in cases:
        a = spark.read.parquet(plain).filter(wanted)
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))
        scanned, before = _scanned(b), _scanned(a)
        print(wanted, scanned, before, total)
        assert scanned < total / 3 and scanned < before


def test_layout_keeps_every_row(spark, tmp_path):
    rows = B.readings(spark, "/root/testdata/sf0.001").limit(50)
    no_time = rows.withColumn("report_time", F.lit(None).cast("timestamp_ntz"))
    no_vehicle = rows.withColumn("vehicle_tag", F.lit(None).cast("string"))
    for n, df in enumerate((rows.unionByName(no_time).unionByName(no_vehicle), no_time, rows.limit(1), rows.limit(0))):
        write_readings(df, str(tmp_path / str(n)), files=4)
        assert sorted(map(repr, read_readings(spark, str(tmp_path / str(n))).collect())) == sorted(map(repr, df.collect()))
