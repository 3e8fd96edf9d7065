import re
from collections import Counter, defaultdict
from hashlib import sha256

import pytest

from fleetstops.llm import exact_dedup as ed
from fleetstops.llm.common import shared_path


@pytest.fixture()
def index(spark):
    return ed.open_index(spark, shared_path(spark, "index"), 4)


def expected(rows):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    groups = defaultdict(list)
    for i, t in norm:
        groups[t].append(i)
    keep = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return norm, groups, keep


def test_rows_match_brute_force(odd, index):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    norm, groups, keep = expected(rows)
    got = ed.dedup(odd, index, 4).collect()
    want = Counter((i, keep[t], len(groups[t]), sha256(t.encode()).hexdigest()) for i, t in norm)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_kept_rows_have_all_columns_once(odd, index):
    got = ed.keep_new(odd, index, 4)
    assert got.columns == odd.columns
    _, groups, keep = expected([(r.doc_id, r.text) for r in odd.collect()])
    assert Counter(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in got.collect()) == Counter(dict.fromkeys(groups, 1))


def test_second_batch_meets_the_index(spark, index):
    first = spark.createDataFrame([(5, "a b"), (2, "a  b"), (7, "c")], "doc_id long, text string")
    second = spark.createDataFrame([(1, "a b"), (9, "d"), (8, "d"), (4, "a\tb")], "doc_id long, text string")
    ed.dedup(first, index, 4).collect()
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in ed.dedup(second, index, 4).collect()}
    assert got == {1: (2, 2, False), 4: (2, 2, False), 8: (8, 2, True), 9: (8, 2, False)}
    assert spark.table(index).count() == 3


def test_index_outlives_its_table_name(spark):
    path = shared_path(spark, "index")
    docs = spark.createDataFrame([(5, "a b")], "doc_id long, text string")
    assert ed.keep_new(docs, ed.open_index(spark, path, 4), 4).count() == 1
    assert ed.keep_new(docs, ed.open_index(spark, path, 4), 4).count() == 0


def test_anti_join_moves_the_batch_only(spark, odd, index):
    plan = ed.new_digests(ed._groups(ed._narrow(odd)).select("digest", "keep_id"), index)._jdf.queryExecution().executedPlan().toString()
    side = plan[plan.index("SortMergeJoin") :]
    assert "LeftAnti" in side and "Bucketed: true" in side


def test_empty(none, index):
    assert ed.dedup(none, index, 4).count() == 0
    assert ed.keep_new(none, index, 4).count() == 0


def test_index_reopened_under_another_shuffle_setting(spark):
    path, key = shared_path(spark, "index"), "spark.sql.shuffle.partitions"
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(200)], "doc_id long, text string")
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "40")
        n = ed.session_buckets(spark)
        assert ed.keep_new(docs, ed.open_index(spark, path, n), n).count() == 200
        spark.conf.set(key, "61")
        with pytest.raises(ValueError, match="40 buckets, not 61"):
            ed.open_index(spark, path, ed.session_buckets(spark))
        n = ed.session_buckets(spark, path)
        index = ed.open_index(spark, path, n)
        assert n == 40 and spark.table(index).count() == 200
        assert ed.keep_new(docs, index, n).count() == 0
    finally:
        spark.conf.set(key, before)


def test_index_without_its_number_of_buckets_is_refused(spark):
    path = shared_path(spark, "index")
    spark.createDataFrame([("x", 1)], "digest string, keep_id long").write.parquet(path)
    with pytest.raises(ValueError, match="no number of buckets"):
        ed.open_index(spark, path, 4)


def test_a_batch_that_is_run_again_gives_the_same_rows(spark, odd, index):
    """Its result was lost after the index had its digests: nothing is lost, nothing is added twice."""
    first = Counter(map(tuple, ed.dedup(odd, index, 4, "b1").collect()))
    held = spark.table(index).count()
    assert Counter(map(tuple, ed.dedup(odd, index, 4, "b1").collect())) == first
    texts = Counter(r.text for r in ed.keep_new(odd, index, 4, "b1").collect())
    assert sum(texts.values()) == sum(r[3] for r in first.elements()) > 0
    assert spark.table(index).count() == held
    later = ed.dedup(odd, index, 4, "b2").collect()
    assert not any(r.kept for r in later) and spark.table(index).count() == held


def test_a_half_written_append_is_completed(spark, index):
    docs = spark.createDataFrame([(k, f"t{k}") for k in range(50)], "doc_id long, text string")
    half = ed._groups(ed._narrow(docs)).filter("keep_id < 20")
    ed.append(half, index, 4, "b1")
    assert sum(r.kept for r in ed.dedup(docs, index, 4, "b1").collect()) == 50
    assert spark.table(index).count() == spark.table(index).select("digest").distinct().count() == 50


@pytest.mark.parametrize("batches", [1, 3, 7])
def test_ranges_through_one_index_equal_brute_force(spark, odd, index, batches):
    norm, groups, keep = expected([(r.doc_id, r.text) for r in odd.collect()])
    got = ed.dedup_in_batches(odd, index, 4, batches).collect()
    want = Counter((i, keep[t], len(groups[t]), sha256(t.encode()).hexdigest()) for i, t in norm)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    if batches > 1:
        assert spark.table(index).select("batch").distinct().count() > 1


def test_compaction_keeps_the_rows_in_one_file_a_bucket(spark):
    path = shared_path(spark, "index")
    docs = [spark.createDataFrame([(100 * b + k, f"t{k * (b + 1)}") for k in range(60)], "doc_id long, text string") for b in range(3)]
    index = ed.open_index(spark, path, 4)
    for b, part in enumerate(docs):
        ed.dedup(part, index, 4, f"b{b}").collect()
    before = Counter(map(tuple, spark.table(index).collect()))
    assert len(spark.table(index).inputFiles()) > 4
    small = ed.compact(spark, path, 4)
    assert Counter(map(tuple, spark.table(small).collect())) == before and len(spark.table(small).inputFiles()) <= 4
    # Opened anew it is the compacted one, appends go on there, and a second compaction replaces it.
    index = ed.open_index(spark, path, 4)
    more = spark.createDataFrame([(900, "t0"), (901, "new")], "doc_id long, text string")
    assert {r.doc_id: r.kept for r in ed.dedup(more, index, 4, "b3").collect()} == {900: False, 901: True}
    assert spark.table(ed.compact(spark, path, 4)).count() == sum(before.values()) + 1
    assert spark.table(ed.open_index(spark, path, 4)).count() == sum(before.values()) + 1
    plan = ed.new_digests(ed._groups(ed._narrow(more)), ed.open_index(spark, path, 4), "b4")._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange") == 1
