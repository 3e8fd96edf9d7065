import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from fleetstops.llm import simhash as sh
from fleetstops.llm.components import components


def slow_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    ones = Counter()
    for s in shingles:
        h = xxhash.xxh64(s.encode(), seed=42).intdigest()
        ones.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def joined(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


def slow_groups(fps, ids):
    near = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    root = joined(len(fps), near)
    least = {}
    for r, i in zip(root, ids, strict=True):
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return [least[r] for r in root]


@pytest.mark.parametrize("blocks", [2, 3, 4])
def test_every_linked_pair_meets_at_an_anchor(blocks):
    rng = np.random.default_rng(3)
    for _ in range(300):
        a = int(rng.integers(0, 1 << 63)) * 2 + int(rng.integers(0, 2))
        b = a
        for bit in rng.choice(64, rng.integers(0, 5), replace=False):
            b ^= 1 << int(bit)
        rows, cells = sh.anchors(np.array([a, b], dtype=np.uint64), 4, blocks)
        assert set(cells[rows == 0].tolist()) & set(cells[rows == 1].tolist())
        assert len(set(cells[rows == 0].tolist())) == (rows == 0).sum()


def test_links_connect_exactly():
    rng = random.Random(4)
    for _ in range(200):
        base = [rng.getrandbits(64) for _ in range(4)]
        points = list({rng.choice(base) ^ sum(1 << b for b in rng.sample(range(12), rng.randint(0, 6))) for _ in range(rng.choice([5, 40, 400]))})
        a, b = sh.links(np.array(points, dtype=np.uint64))
        place = {p: i for i, p in enumerate(points)}
        assert all((x ^ 0) in place for x in a.tolist() + b.tolist()) and len(a) < len(points)
        got = joined(len(points), [(place[x], place[y]) for x, y in zip(a.tolist(), b.tolist(), strict=True)])
        assert got == joined(len(points), [(i, j) for i in range(len(points)) for j in range(i) if (points[i] ^ points[j]).bit_count() <= 4])


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, k) for k in range(300, 340)] + [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(900, 900), (-5, 12)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({x for e in edges for x in e if e[0] != e[1]})
    place = {n: i for i, n in enumerate(nodes)}
    want = joined(len(nodes), [(place[a], place[b]) for a, b in edges if a != b])
    assert got == {n: nodes[want[place[n]]] for n in nodes}


def test_rows(odd, none):
    rows = odd.collect()
    fps = [slow_fingerprint(r.text) for r in rows]
    want = Counter(zip([r.doc_id for r in rows], fps, slow_groups(fps, [r.doc_id for r in rows]), strict=True))
    got = sh.groups(odd).collect()
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == want
    assert sh.groups(none).count() == 0 and sh.keep_one(none).count() == 0


def test_documents(spark, documents):
    rows = documents.collect()
    fps = [slow_fingerprint(r.text) for r in rows]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in sh.op4_simhash(spark, "/root/testdata/sf0.001").collect()}
    comp = slow_groups(fps, [r.doc_id for r in rows])
    assert got == {r.doc_id: (f"{f:016x}", c) for r, f, c in zip(rows, fps, comp, strict=True)}


def test_split_cells_give_the_same_links(spark):
    rng = random.Random(8)
    centre = rng.getrandbits(63)
    points = list({centre ^ sum(1 << b for b in rng.sample(range(40), rng.randint(0, 5))) for _ in range(600)})
    df = spark.createDataFrame([(p,) for p in points], "fp long")
    got = {r.node: r.root for r in components(sh.near_links(df, cell=50)).collect()}
    want = joined(len(points), [(i, j) for i in range(len(points)) for j in range(i) if (points[i] ^ points[j]).bit_count() <= 4])
    groups = {}
    for p, w in zip(points, want, strict=True):
        groups.setdefault(w, set()).add(got.get(p, p))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_one_row_of_each_component_stays(odd):
    kept = sh.keep_one(odd)
    assert kept.columns == odd.columns
    rows = odd.collect()
    fps = [slow_fingerprint(r.text) for r in rows]
    root = joined(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    groups = {}
    for r, k in zip(rows, root, strict=True):
        groups.setdefault(k, []).append(r.doc_id)
    want = Counter(min((i for i in ids if i is not None), default=None) for ids in groups.values())
    assert Counter(r.doc_id for r in kept.collect()) == want
