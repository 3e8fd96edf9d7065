import re
from collections import Counter, defaultdict

import pytest

from fleetstops.llm import mixing as mx


def water(sizes, weights, total):
    """Targets by sharing the excess again and again."""
    target, free, left = {}, dict(weights), total
    while free:
        unit = left / sum(free.values())
        full = [s for s in free if unit * free[s] > 2 * sizes[s]]
        if not full:
            return target | {s: unit * w for s, w in free.items()}
        for s in full:
            target[s] = 2 * sizes[s]
            left -= target[s]
            del free[s]
    return target


def sizes_of(rows):
    sizes = defaultdict(int)
    for s, t in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    return sizes


def test_targets_and_copies(odd):
    rows = odd.collect()
    sizes = sizes_of((r.source, r.text) for r in rows)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = water(sizes, {s: [3, 1, 2][k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    got = mx.plan_mix(odd).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source])
        rate = target[r.source] / sizes[r.source] if sizes[r.source] else 0
        assert int(rate) <= r.copies <= int(rate) + (rate > int(rate)) and r.taken == r.size * r.copies
    assert mx.plan_mix(odd).collect().sort(key=str) == got.sort(key=str)


def test_mix_emits_what_is_planned(odd):
    plan = Counter()
    for r in mx.plan_mix(odd).collect():
        plan[r.doc_id, r.source, r.size] += r.copies
    out = mx.mix(odd)
    assert out.columns == odd.columns
    got = Counter((r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in out.collect())
    assert got == Counter({k: n for k, n in plan.items() if n})


def test_taken_words_come_near_targets(spark, documents):
    got = mx.plan_mix(documents).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert sum(r["sum(taken)"] for r in got) == pytest.approx(sum(r["max(target)"] for r in got), rel=0.2)


def test_native(documents):
    plan = mx.mix(documents)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty(none):
    assert mx.plan_mix(none).count() == 0
    assert mx.mix(none).count() == 0
