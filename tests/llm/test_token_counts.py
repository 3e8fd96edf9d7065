import random
import re

from tokenizers import models

from fleetstops.llm import token_counts as tc


def library():
    """The tokenizers library's unigram model over the same pieces and scores."""
    pieces = [("<unk>", 0.0), *((f"<0x{b:02X}>", -1e6) for b in range(256)), *tc.zipf_scores(tc.PIECES).items()]
    return models.Unigram(pieces, unk_id=0, byte_fallback=True)


def test_words_equal_library(documents):
    rng, own, lib = random.Random(1), tc.UnigramCounter(tc.zipf_scores(tc.PIECES)), library()
    words = {w for r in documents.limit(60).collect() for w in r.text.split()}
    words |= {"".join(rng.choice("abé日ß\U0001f600ingth") for _ in range(rng.randint(1, 40))) for _ in range(3000)}
    got = own.counts(list(words))
    assert got == {w: len(lib.tokenize(tc.MARK + w)) for w in words}


def test_shared_beginnings_are_computed_once():
    own = tc.UnigramCounter(tc.zipf_scores(tc.PIECES))
    own.counts(["abcd", "abce", "ab", "abcdx"])
    assert own.nodes == len({m[:k] for w in ("abcd", "abce", "ab", "abcdx") for m in [tc.MARK + w] for k in range(1, len(m) + 1)})


def test_rows(odd, none):
    lib = library()
    got = sorted(map(str, (tuple(r) for r in tc.count_tokens(odd).collect())))
    want = []
    for r in odd.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        want.append((r.doc_id, len(words), sum(len(lib.tokenize(tc.MARK + w)) for w in words)))
    assert got == sorted(map(str, want))
    assert tc.count_tokens(none).count() == 0


def test_table_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(tc, "WORDS_KEPT", 10)
    own = tc.UnigramCounter(tc.zipf_scores(tc.PIECES))
    texts = [f"word{i} other{i} the" for i in range(40)]
    whole = tc.UnigramCounter(tc.zipf_scores(tc.PIECES)).texts(texts)
    assert tuple(map(sum, zip(*(map(sum, own.texts([t])) for t in texts), strict=True))) == tuple(map(sum, whole))
    assert len(own._known) <= 10 + 4


def test_each_shared_beginning_is_computed_once_over_all_batches(documents):
    own = tc.UnigramCounter(tc.zipf_scores(tc.PIECES))
    texts = [r.text for r in documents.limit(80).collect()]
    for at in range(0, len(texts), 7):
        own.texts(texts[at : at + 7])
    words = {tc.MARK + w for t in texts for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")}
    assert max(map(len, words)) <= tc.DEPTH
    assert own.nodes == len({w[:k] for w in words for k in range(1, len(w) + 1)}) == len(own._best) - 1


def test_full_trie_and_long_words(monkeypatch):
    rng, lib = random.Random(3), library()
    words = ["".join(rng.choice("abcdetion") for _ in range(rng.choice([1, 4, 9, 30, 300]))) for _ in range(300)]
    words += ["a" * 50, "a" * 49 + "b", "a" * 51]
    want = {w: len(lib.tokenize(tc.MARK + w)) for w in words}
    for depth, nodes in ((200, 800_000), (5, 40), (31, 100), (1, 3)):
        monkeypatch.setattr(tc, "DEPTH", depth)
        monkeypatch.setattr(tc, "NODES_KEPT", nodes)
        own = tc.UnigramCounter(tc.zipf_scores(tc.PIECES))
        assert own.counts(words) == want
        texts = [" ".join(words[k::7]) for k in range(7)]
        for _ in range(2):
            assert own.texts(texts)[1] == [sum(want[w] for w in words[k::7]) for k in range(7)]
        assert len(own._best) <= nodes


def test_scores_are_a_parameter(documents):
    pieces = tc.file_scores(tc.PIECES)
    assert pieces.keys() == tc.zipf_scores(tc.PIECES).keys()
    lib = models.Unigram([("<unk>", 0.0), *((f"<0x{b:02X}>", -1e6) for b in range(256)), *pieces.items()], unk_id=0, byte_fallback=True)
    rows = documents.limit(5)
    got = {r.doc_id: r.n_tokens for r in tc.count_tokens(rows, scores=tc.file_scores).collect()}
    assert got == {r.doc_id: sum(len(lib.tokenize(tc.MARK + w)) for w in re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows.collect()}
