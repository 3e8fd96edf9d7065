import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetstops.llm import suffix_dedup as sd

SMALL = (8, 10, 13, 16)


def brute_force(docs, length):
    """Counter of (doc_id, n_bytes, spans, kept digest), from a table of all strings of ``length`` bytes in order."""
    order = sorted(range(len(docs)), key=lambda k: (docs[k][0] is None, docs[k][0] or 0, _tie(docs, k)))
    seen, out = set(), Counter()
    for k in order:
        doc_id, text = docs[k]
        gone = np.zeros(len(text), bool)
        for p in range(len(text) - length + 1):
            if text[p : p + length] in seen:
                gone[p : p + length] = True
            seen.add(text[p : p + length])
        edges = np.flatnonzero(np.diff(np.r_[False, gone, False]))
        spans = tuple(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
        kept = bytes(b for b, g in zip(text, gone, strict=True) if not g)
        out[doc_id, len(text), spans, sha256(kept).hexdigest()] += 1
    return out


_TIES = {}


def _tie(docs, k):
    return _TIES.get(docs[k], 0)


def got(frame):
    return Counter((r.doc_id, r.n_bytes, tuple((s.start, s.end) for s in r.spans), sha256(r.kept).hexdigest()) for r in frame.collect())


def check(spark, docs, ladder, parts=5):
    frame = spark.createDataFrame(docs, "doc_id long, text binary").repartition(parts)
    _TIES.clear()
    _TIES.update({(r.doc_id, bytes(r.text)): r.tie for r in sd._keyed(frame).collect()})
    assert got(sd.remove_repeats(frame, ladder)) == brute_force([(i, t or b"") for i, t in docs], ladder[-1])


def test_random_texts_of_few_letters(spark):
    rng = random.Random(3)
    docs = []
    for k in range(150):
        parts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 30))) for _ in range(3)]
        parts += [b"abcabcabc" * rng.randint(0, 6), b"z" * rng.randint(0, 60), b"a passage that repeats" * rng.randint(0, 2)]
        rng.shuffle(parts)
        docs.append((k * 7 % 151, b"".join(parts)))
    check(spark, docs, SMALL)
    check(spark, docs, (8, 16))


def test_copies_ids_and_empty_texts(spark):
    rng = random.Random(4)
    base = [bytes(rng.randrange(256) for _ in range(rng.randint(100, 700))) for _ in range(20)]
    docs = [(k, base[k % 20][: 40 * k]) for k in range(60)]
    docs += [(5, base[5]), (5, base[5]), (5, base[6]), (None, base[7]), (None, base[7]), (None, base[8]), (None, None), (70, b""), (71, None), (2**63 - 1, base[7])]
    docs += [(80 + k, base[k % 3] + base[k % 5][50:300]) for k in range(60)]
    check(spark, docs, sd.LADDER)


def test_periodic_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(sd, "STEP", 500)
    rng = random.Random(5)
    line = bytes(rng.randrange(97, 123) for _ in range(130))
    docs = [(1, b"x" * 3000), (2, b"ab" * 1500), (3, line * 20), (4, b"-" + line * 3 + b"=" * 150), (5, bytes(rng.randrange(97, 100) for _ in range(4000)))]
    check(spark, docs, sd.LADDER, 2)


def test_given_documents(spark):
    docs = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    check(spark, docs, sd.LADDER)
    assert sum(bool(k[2]) for k in brute_force(docs, 100)) > 10


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=60) | st.text("ab", max_size=60).map(str.encode) | st.integers(0, 60).map(lambda n: b"abc" * n), max_size=6))
def test_segments_hold_all_windows_once(pieces):
    """Equal windows: equal ranks; equal phrases: equal bytes; windows of one segment without a tie differ."""
    for size in SMALL:
        s = sd.segments(pieces, size, 16, 8)
        rank_of, phrase, seen = {}, {}, []
        for piece, start, n, rank, p, tie in zip(*(s[c].tolist() for c in ("piece", "start", "n", "rank", "phrase", "tie")), strict=True):
            own = [pieces[piece][k : k + 16] for k in range(start, start + n)]
            seen += [(piece, k) for k in range(start, start + n)]
            assert all(rank_of.setdefault(w, rank) == rank for w in own)
            assert phrase.setdefault((rank, p), (piece, start)) and own == [pieces[phrase[rank, p][0]][k : k + 16] for k in range(phrase[rank, p][1], phrase[rank, p][1] + n)]
            assert tie or len(set(own)) == n
        assert seen == [(k, p) for k, t in enumerate(pieces) for p in range(len(t) - 15)]


def test_a_rank_met_in_many_batches_sends_few_rows(spark):
    """One passage in every document, other words around: rows of one rank's group don't follow the documents."""
    rng = random.Random(6)
    passage = bytes(rng.randrange(97, 123) for _ in range(400))
    ids = np.arange(300)
    texts = [bytes(rng.randrange(97, 123) for _ in range(150)) + passage + bytes(rng.randrange(97, 123) for _ in range(150)) for _ in ids]
    out = sd.batch_rows(ids, ids * 0, ids * 0, texts, 32, 100, 32, False)
    state, deal = (out[c].to_numpy() for c in ("state", "deal"))
    assert max(Counter(deal.tolist()).values()) == 1
    assert (state == sd.DECIDED).sum() > 5 * 299


def test_lengths_are_checked(none):
    with pytest.raises(ValueError, match="must rise"):
        sd.remove_repeats(none, (64, 32, 100))


def test_empty_and_odd_tables(spark, none, odd):
    assert sd.remove_repeats(none).count() == 0
    rows = [(r.doc_id, (r.text or "").encode()) for r in odd.collect()]
    frame = odd.select("doc_id", "text")
    _TIES.clear()
    _TIES.update({(r.doc_id, bytes(r.text)): r.tie for r in sd._keyed(frame).collect()})
    assert got(sd.remove_repeats(odd)) == brute_force(rows, 100)
