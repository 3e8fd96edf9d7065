import zlib
from collections import Counter
from fractions import Fraction
from hashlib import sha256

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from fleetstops.llm import periodic as pr


def naive_runs(words, times=4, least=6):
    """Every (start, length, period) by trying every period at every start."""
    out, n = [], len(words)
    for q in range(1, n // times + 1):
        k = 0
        while k + q < n:
            end = k
            while end + q < n and words[end] == words[end + q]:
                end += 1
            if end - k + q >= max(least, times * q) and not any(all(words[i] == words[i + d] for i in range(k, end + q - d)) for d in range(1, q)):
                out.append((k, end - k + q, q))
            k = max(end, k + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def naive_row(doc_id, text):
    words = [w for w in (text or "").translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ") if w]
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = naive_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *top, runs and 1000 * top[1] // top[2] or None, sha256(lines.encode()).hexdigest(), sha256(kept.encode()).hexdigest())


pieces = st.lists(st.tuples(st.lists(st.sampled_from("abcdef"), min_size=1, max_size=7), st.integers(1, 7)), max_size=6)


@settings(max_examples=400, deadline=None)
@given(pieces, st.integers(4, 6), st.integers(2, 12))
@example([(list("ab"), 4), (list("abab"), 2)], 4, 6)
@example([(list("a"), 6), (list("b"), 1), (list("aab"), 5)], 4, 6)
def test_runs_of_random_repetitions(parts, times, least):
    words = [w.encode() for piece, n in parts for w in piece * n]
    assert pr.text_runs([words], times, least) == [naive_runs(words, times, least)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab", max_size=40), max_size=6))
def test_texts_of_a_batch_stay_apart(texts):
    words = [[c.encode() for c in t] for t in texts]
    assert pr.text_runs(words) == [naive_runs(w) for w in words]


@pytest.mark.parametrize("length", [1, 5, 64, 333, 1024])
def test_long_periods(length):
    root = [str(k % (length // 2 + 1)).encode() + (b"x" if k == length - 1 else b"") for k in range(length)]
    words = [b"start", *(root * 12)[: 4 * length + length // 3 + 6], b"end"]
    assert (1, len(words) - 2, length) in pr.text_runs([words])[0]


def test_fewer_periods_are_refused():
    with pytest.raises(ValueError, match="at least 4"):
        pr.text_runs([[b"a"]], times=3)


def test_prose_splits_to_nothing():
    import numpy as np

    words = np.arange(5000) % 1700
    assert pr.split_segments(words, np.zeros(5000, int)) == []


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    got = Counter(map(tuple, pr.op13_periodic_runs(spark, sf).collect()))
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    short = [r for r in rows if len(r.text or "") < 20_000]
    assert len(short) > 0.95 * len(rows)
    want = Counter(naive_row(*r) for r in short)
    assert not want - got and sum(got.values()) == len(rows)
    assert sum(r[1] > 0 for r in got) > 10


def test_odd_table(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    got = pr.detect(odd).collect()
    assert len(got) == len(rows)
    for doc_id, text in rows:
        if len(text or "") < 40_000:
            words = [w.encode() for w in (text or "").translate(str.maketrans("\t\n\v\f\r", "     ")).split(" ") if w]
            want = naive_runs(words)
            assert any(r.doc_id == doc_id and [tuple(x) for x in r.runs] == want and r.n_words == len(words) for r in got)


def test_digests_of_odd_ids(spark, none, odd, tmp_path_factory):
    from fleetstops.llm.common import shared_path

    for docs in (odd, none):
        folder = shared_path(spark, "odd")
        docs.write.parquet(f"{folder}/documents.parquet")
        got = Counter(map(tuple, pr.op13_periodic_runs(spark, folder).collect()))
        small = [(r.doc_id, r.text) for r in docs.collect() if len(r.text or "") < 40_000]
        assert not Counter(naive_row(*r) for r in small) - got and sum(got.values()) == docs.count()
