import re
from collections import Counter
from fractions import Fraction
from itertools import permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetstops.llm import filter_audit as fa


def failures(rows):
    """The set of failures of each (doc_id, text, lang), row against row."""
    out = []
    for i, t, _ in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words))
        f += "C" * (100 * len(re.findall("[A-Z]", t)) > 3 * len(t)) + "D" * bool(re.search(r"[#$%&*|]", t))
        f += "E" * any(i is not None and j is not None and j < i and (u or "") == t for j, u, _ in rows)
        out.append(f)
    return out


def brute_force(rows, good, toxic):
    failed, out = failures(rows), {}
    for part in {lang or "" for _, _, lang in rows}:
        of = [(f, i) for f, (i, _, lang) in zip(failed, rows, strict=True) if (lang or "") == part]
        removed_by = Counter()
        for order in permutations("ABCDE"):
            left = of
            for step, x in enumerate(order, 1):
                now = [d for d in left if x in d[0]]
                left = [d for d in left if x not in d[0]]
                removed_by[x] += len(now)
                fail = sum(x in f for f, _ in of)
                lost = [sum(i in ids for _, i in now) for ids in (good, toxic)]
                out[part, "".join(order), step] = [len(left), len(now), fail - len(now), sum(f == x for f, _ in of), *lost, x]
        for key, row in out.items():
            if key[0] == part:
                row[-1] = removed_by[row[-1]]
    return {k: tuple(v) for k, v in out.items()}


def compare(spark, docs, labels):
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    marks = labels.collect()
    good, toxic = ({r.doc_id for r in marks if r[c] == 1} - {None} for c in ("quality", "toxic"))
    want = brute_force(rows, good, toxic)
    got = {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in fa.audit(docs, labels).collect()}
    assert got == want


def test_odd_table_against_brute_force(spark, odd):
    long = " ".join(f"w{k}" for k in range(250))
    more = [(50, long, "de"), (51, long, "de"), (51, long, "de"), (49, long, None), (None, long, "de"), (52, long + " #", ""), (53, "A B C " * 90, "de"), (54, "A B C " * 90, "fr")]
    extra = spark.createDataFrame(more, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(49, 1, 0), (50, 0, 1), (50, 1, None), (51, 1, 1), (None, 1, 1), (3, 1, 0), (53, None, 1)], "doc_id long, quality int, toxic int")
    compare(spark, odd.select("doc_id", "text", "lang").unionByName(extra), labels)
    assert fa.audit(odd, labels).columns == ["part", "filter_order", "step", *fa.COUNTS]


def test_given_documents_against_brute_force(spark, documents):
    compare(spark, documents, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))


def test_empty(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert fa.audit(none, labels).count() == 0


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.integers(0, 31), st.integers(0, 10**12), max_size=32))
def test_least_squares_give_shapley_values(counts):
    v = fa.coalition_removals(counts)
    want = [Fraction(0)] * 5
    for order in permutations(range(5)):
        s = 0
        for f in order:
            want[f] += Fraction(v[s | 1 << f] - v[s], 120)
            s |= 1 << f
    assert fa.shapley_values(v) == want


def test_hot_text_is_summed_before_it_moves(spark):
    """A text held by all rows reaches the second stage as one row for each task and kind."""
    docs = spark.range(0, 4000, 1, 4).selectExpr("id AS doc_id", "'same text' AS text", "'en' AS lang")
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    rows = {r.fails: (r.docs, r.good, r.toxic) for r in fa.outcomes(docs, labels).collect() if r.docs}
    assert rows == {1: (1, 1, 0), 17: (3999, 0, 0)}


def test_singular_part_is_solved():
    assert fa.shapley_values([0] * 32) == [0] * 5
    with pytest.raises(StopIteration):
        fa.solve([[Fraction(0)]], [Fraction(1)])
