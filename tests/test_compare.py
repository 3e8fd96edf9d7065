"""The dataset comparer finds injected differences; identical inputs give empty results."""

import datetime as dt

from pyspark.sql import functions as F

from fleetstops.operators import compare as C


def df_ab(spark):
    a = spark.createDataFrame(
        [(1, "x", 1.0, dt.datetime(2024, 1, 1)), (2, "y", float("nan"), None), (3, None, 3.0, dt.datetime(2024, 1, 2))],
        "id long, s string, d double, t timestamp_ntz",
    )
    return a


def test_schema_diff(spark):
    a = df_ab(spark)
    assert all(r.equal for r in C.schema_diff(a, a).collect())
    b = a.withColumnRenamed("s", "s2").withColumn("d", F.col("d").cast("float"))
    rows = {r.position: r for r in C.schema_diff(a, b).collect()}
    assert not rows[2].same_name and rows[2].same_type
    assert not rows[3].same_type and not rows[3].equal
    assert C.schema_diff(a, b.withColumn("d", F.col("d").cast("double")), ignore_names=True, ignore_nullable=True).filter(
        "NOT equal"
    ).count() == 0
    assert C.schemas_equal(a, a) and not C.schemas_equal(a, b)
    assert C.schema_diff(a, a.drop("t")).filter("NOT equal").count() == 1


def test_count_and_content_diff(spark):
    a = df_ab(spark)
    assert C.count_diff(a, a).first().equal
    b = a.filter("id != 2").unionByName(a.filter("id = 3"))
    cd = C.count_diff(a, b).first()
    assert (cd.count_a, cd.count_b, cd.equal) == (3, 3, True)
    diff = C.content_diff(a, b).collect()
    assert sorted((r.id, r.side) for r in diff) == [(2, "a"), (3, "b")]
    assert C.content_diff(a, a).count() == 0  # NULL = NULL and NaN = NaN inside rows


def test_ordered_content_diff(spark):
    a = spark.range(0, 50, 1, 4).withColumn("v", F.col("id") * 2)
    b = spark.range(0, 50, 1, 3).withColumn("v", F.when(F.col("id") == 17, F.lit(-1)).otherwise(F.col("id") * 2))
    d = C.content_diff(a, b, ordered=True).collect()
    assert sorted((r.row_index, r.side) for r in d) == [(17, "a"), (17, "b")]
    assert C.content_diff(a, a, ordered=True).count() == 0
    idx = C.with_row_index(spark.range(0, 1000, 1, 7))
    assert idx.filter(F.col("row_index") != F.col("id")).count() == 0


def test_content_diff_repeats_a_row_as_often_as_it_is_in_surplus(spark):
    n = 150_000  # more than one block of copies
    a = spark.range(n).select(F.lit(1).alias("v")).unionByName(spark.range(3).select(F.lit(2).alias("v")))
    b = spark.range(2).select(F.lit(2).alias("v"))
    got = {(r.v, r.side): r["count"] for r in C.content_diff(a, b).groupBy("v", "side").count().collect()}
    assert got == {(1, "a"): n, (2, "a"): 1}


def test_content_is_compared_under_equal_schemas_only(spark):
    import pytest

    a = spark.createDataFrame([(1,)], "v long")
    for b in (a.withColumn("v", F.col("v").cast("string")), a.withColumnRenamed("v", "w"), a.withColumn("w", F.lit(1))):
        for compare in (lambda x, y: C.content_diff(x, y), lambda x, y: C.content_diff(x, y, ordered=True), lambda x, y: C.approx_diff(x, y, 0.1)):
            with pytest.raises(ValueError, match="schemas differ"):
                compare(a, b)


def test_approx_diff_of_infinities(spark):
    inf, nan = float("inf"), float("nan")
    a = spark.createDataFrame([(1, inf), (2, -inf), (3, inf), (4, nan), (5, inf), (6, None)], "id long, d double")
    b = spark.createDataFrame([(1, inf), (2, -inf), (3, -inf), (4, nan), (5, 1.0), (6, None)], "id long, d double")
    assert C.approx_diff(a, a, 0.1, key=["id"]).count() == 0
    assert sorted(r.id for r in C.approx_diff(a, b, 0.1, key=["id"]).collect()) == [3, 5]


def test_approx_diff(spark):
    a = df_ab(spark)
    b = a.withColumn("d", F.col("d") + 0.001).withColumn("t", F.col("t") + F.expr("INTERVAL 2 MILLISECONDS"))
    assert C.approx_diff(a, b, 5.0, key=["id"]).count() == 0  # within 5 (ms for times); NaN = NaN; NULL = NULL
    d = {r.id: r.columns for r in C.approx_diff(a, b, 0.0005, key=["id"]).collect()}
    assert d == {1: "d,t", 3: "d,t"}
    c = a.withColumn("s", F.when(F.col("id") == 3, F.lit("z")).otherwise(F.col("s"))).filter("id != 1")
    d2 = sorted((r.id, r.side, r.columns) for r in C.approx_diff(a, c, 0.01, key=["id"]).collect())
    assert d2 == [(1, "a", ""), (3, "both", "s")]
    # positional when no key
    assert C.approx_diff(a, a, 0.0).count() == 0
    assert C.default_sort(a).columns == ["id", "s", "d", "t"]


def test_diff_with_user_predicate(spark):
    a = df_ab(spark)
    b = a.withColumn("s", F.upper("s"))
    same_ci = lambda x, y: F.lower(x["s"]).eqNullSafe(F.lower(y["s"])) & x["d"].eqNullSafe(y["d"])
    assert C.diff_with(a, b, same_ci, key=["id"]).count() == 0
    exact = lambda x, y: x.eqNullSafe(y)
    assert sorted(r.id for r in C.diff_with(a, b, exact, key=["id"]).collect()) == [1, 2]


def test_keyed_comparison_refuses_repeated_keys(spark):
    import pytest

    a = df_ab(spark)
    b = a.unionByName(a.filter("id = 1"))
    with pytest.raises(ValueError):
        C.approx_diff(a, b, 0.1, key=["id"])
    with pytest.raises(ValueError):
        C.diff_with(a, b, lambda x, y: x.eqNullSafe(y), key=["id"])


def _sorted_rows(df):
    return sorted(map(repr, df.collect()))


def test_digests_find_what_the_full_comparison_finds(spark):
    nest = "CASE WHEN id % 4 = 0 THEN named_struct('x', CAST(NULL AS INT), 'y', 1) ELSE named_struct('x', 1, 'y', CAST(NULL AS INT)) END"
    a = spark.range(3000).selectExpr("id", "IF(id % 5 = 0, NULL, id % 7) AS p", "IF(id % 5 = 0, id % 7, NULL) AS q", "id / 3 AS d", f"{nest} AS n")
    swapped = a.filter("id = 20").selectExpr("id", "q AS p", "p AS q", "d", "n")
    nested = a.filter("id = 24").selectExpr("id", "p", "q", "d", "named_struct('x', 1, 'y', CAST(NULL AS INT)) AS n")
    b = a.filter("id NOT IN (20, 24, 31)").unionByName(swapped).unionByName(nested).unionByName(a.filter("id IN (7, 8)"))
    want = _sorted_rows(C.content_diff(a, b))
    assert len(want) == 7
    for buckets, levels in ((1, 1), (64, 1), (64, 2), (4096, 3)):
        assert _sorted_rows(C.content_diff_by_digest(a, b, buckets, levels)) == want
    assert C.content_diff_by_digest(a, a).count() == 0
    assert C.content_diff_by_digest(a.limit(0), a).count() == 3000


def test_digests_move_only_buckets_that_differ(spark, tmp_path):
    """Rows that leave the last level: those of differing buckets, not the table; no row-wide exchange before."""
    a = spark.range(200_000).selectExpr("id", "id % 13 AS v")
    b = a.withColumn("v", F.when(F.col("id").isin(5, 77), F.lit(-1)).otherwise(F.col("v")))
    moved = []
    full = C.content_diff
    C.content_diff = lambda x, y: moved.extend((x.count(), y.count())) or full(x, y)
    try:
        diff = C.content_diff_by_digest(a, b, buckets=512)
    finally:
        C.content_diff = full
    assert diff.count() == 4 and max(moved) < 200_000 * (8 / 512) ** 2 + 10
    plan = diff._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 4
