import base64
import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from fleetstops.llm import byte_bpe as bb


@pytest.fixture(scope="module")
def own():
    return bb.ByteBpe(bb.RANKS, leaf_chars=16, leaf_bytes=8)


@pytest.fixture(scope="module")
def library():
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


PARTS = ["a", "b", " ", "\n", "é", "日", "the", "ing", "'s", "'r", "e", "1", "  ", "\t", "#", "!!", "'", "ö", "\U0001f600", "_", "\x1c", "\x85", "aaaa", "===="]


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=120).map("".join))
def test_tree_equals_library(own, library, text):
    ids = library.encode_ordinary(text)
    assert own.encode(text) == ids
    assert own.decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_any_text(own, library, text):
    text = text.encode("utf-8", "ignore").decode()
    assert own.encode(text) == library.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 30_001, "ab" * 20_000, "=" * 20_000 + "é" * 9_000, " " * 20_000 + "x", "thequick" * 5_000, "a b" * 20_000])
def test_long_runs(library, text):
    own = bb.ByteBpe(bb.RANKS)
    ids = library.encode_ordinary(text)
    assert own.encode(text) == ids and own.decode(ids) == text.encode()


def test_every_token_is_its_own_encoding(own):
    """What the proof for joins inside a pre-token rests on: merges, without the shortcut for whole tokens, reach each token."""
    ranks = {b: r for r, b in own.bytes_of.items()}
    for token in own.bytes_of.values():
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            rank, i = min((ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            assert rank < 1 << 30
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert parts == [token]


def test_rows(odd, none, library):
    got = bb.encode_decode(odd).select("doc_id", *bb.digests()).collect()
    want = []
    for r in odd.collect():
        ids = library.encode_ordinary(r.text or "")
        want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    assert bb.encode_decode(none).count() == 0
