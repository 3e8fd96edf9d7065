import random

import numpy as np
import pytest

from fleetstops.llm import neighbours as nb


def brute(rows, queries, k=10):
    """rows: (vec_id, vector); one row of the query's own id and vector is left out."""
    ids = [i for i, _ in rows]
    out = []
    for qid, q in queries:
        dist = []
        own = False
        for i, v in rows:
            if len(v) != len(q):
                continue
            d = float(np.sqrt(((np.array(v, dtype=np.float64) - np.array(q, dtype=np.float64)) ** 2).sum()))
            if i == qid and d == 0 and not own:
                own = True
                continue
            dist.append((d, i is None, i))
        out += [(qid, k + 1, i, d) for k, (d, _, i) in enumerate(sorted(dist, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    assert ids
    return out


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 24))
    turned = nb.rotated(x, 2, 2, 1)
    assert turned.shape == (2, 2, 5, 32)
    assert np.allclose(np.linalg.norm(turned, axis=3), 1)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert np.allclose(turned[0, 1] @ turned[0, 1].T, unit @ unit.T)


def test_own_bucket_is_the_best_bucket():
    x = np.random.default_rng(0).normal(size=(50, 16))
    for functions in (1, 2):
        turned = nb.rotated(x, 3, functions, 1)
        best = nb.best_buckets(turned, 5)
        assert (best[:, :, 0] == nb.own_buckets(turned)).all()
        assert all(len(set(b)) == 5 for b in best.reshape(-1, 5).tolist())


def test_small_odd_table_is_exact(spark):
    rng = random.Random(3)
    rows = [(k, [rng.gauss(0, 1) for _ in range(6)]) for k in range(60)]
    hot = rows[7][1]
    rows += [(k, hot) for k in range(100, 160)] + [(200, hot), (200, hot), (None, hot), (300, [1.0, 2.0]), (301, [1.0, 2.5])]
    bad = [(400, None), (500, []), (600, [0.0] * 6), (700, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (800, [float("nan")] * 6), (900, [float("inf")] + [0.0] * 5)]
    df = spark.createDataFrame([(i, v, "z", "z") for i, v in rows + bad], "vec_id long, vector array<double>, rank string, cell string")
    queries = [(i, v) for i, v in rows if i is not None and i % 100 == 0]
    got = nb.search(df, df.filter("vec_id % 100 = 0").select("vec_id", "vector"), tables=2, probes=16).collect()  # all buckets
    assert sorted(map(str, ((r.query_id, r.rank, r.vec_id, r.score) for r in got))) == sorted(map(str, brute(rows, queries)))


def test_short_answers_are_filled_by_an_exact_scan(spark):
    rng = random.Random(4)
    rows = [(k, [rng.gauss(0, 1) for _ in range(16)]) for k in range(8)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    got = nb.search(df, df.filter("vec_id < 2"), tables=1, probes=1).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(brute(rows, rows[:2]))


@pytest.mark.parametrize("probes", [16, 1])  # all buckets; an exact scan where they leave a query short
def test_different_vectors_under_one_id_and_under_null(spark, probes, monkeypatch):
    monkeypatch.setattr(nb, "BLOCK_POINTS", 7)
    rng = random.Random(6)
    ids = [0, 100, *[5] * 6, *[None] * 6, 0] if probes == 1 else [0, 100, *[5] * 30, *[None] * 30, 0, 100, *range(200, 205)]
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in ids]
    rows += [(None, rows[3][1]), (5, rows[0][1])]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    queries = [(i, v) for i, v in rows if i is not None and i % 100 == 0]
    tables = 2 if probes == 16 else 1
    got = nb.search(df, df.filter("vec_id % 100 = 0"), tables=tables, probes=probes).collect()
    assert sorted(map(str, ((r.query_id, r.rank, r.vec_id, r.score) for r in got))) == sorted(map(str, brute(rows, queries)))


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, vector array<float>")
    assert nb.search(df, df).count() == 0


@pytest.mark.parametrize("blocks", [(16384, 2048), (7, 3)])
def test_recall_on_the_given_vectors(spark, blocks, monkeypatch):
    monkeypatch.setattr(nb, "BLOCK_POINTS", blocks[0])
    monkeypatch.setattr(nb, "BLOCK_QUERIES", blocks[1])
    sf = "/root/testdata/sf0.01"
    got = nb.op8_neighbours(spark, sf).collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows, [(i, v) for i, v in rows if i % 100 == 0])
    by = {(q, i): d for q, _, i, d in want}
    assert len(got) == len(want)
    assert sum((r.query_id, r.vec_id) in by for r in got) >= 0.9 * len(want)
    assert all(by.get((r.query_id, r.vec_id), r.score) == r.score for r in got)
