import io
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from fleetstops.llm import token_files as tf
from fleetstops.llm.common import shared_path


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(P.path("word_bpe_49k.json"))


class Held(io.BytesIO):
    reads = 0

    def size(self):
        return len(self.getvalue())

    def read(self, n=-1):
        self.reads += n
        return super().read(n)


def test_words_equal_library(library):
    import random

    rng, own = random.Random(2), tf.WordTokenizer(tf.TOKENIZER)
    parts = ["a", "B", " ", "\n", "É", "é", "日", "The", "'s", "'RE", "1", "  ", "\t", "#", "!!", "Σ", "ΑΣ ", "İ", "ß", "ǅ", "²", "Ⅷ", "\xa0", " ", "\x1c", "\x85", "<|endoftext|>", "<|", "_", "😀", "ﬁ", "Å", "\x00"]
    for _ in range(5000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode([text]) == [struct.pack(f"<{len(ids)}I", *ids)], repr(text)


def test_every_code_point_equals_library(library):
    """Each code point alone, doubled, and beside letters and digits; those that Python's tables lack are not taken by the rank table."""
    own = tf.WordTokenizer(tf.TOKENIZER)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    fast = [c for c in points if own.by_table(c)]
    slow = set(points) - set(fast)
    assert len(fast) > 250_000 and "\u0558" in slow and "\U00010d50" in slow
    texts = [" ".join(f"a{c}b {c} 1{c} {c}{c} \u00e9{c}" for c in fast[k : k + 200]) for k in range(0, len(fast), 200)]
    for text, got, want in zip(texts, own.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert got == struct.pack(f"<{len(want.ids)}I", *want.ids), ascii(text[:60])
    for c in ["\u0558", "\U00010d50", "\x00", "\u0378"]:
        text = f"a{c}b {c} plain words"
        want = library.encode(text, add_special_tokens=False).ids
        assert own.encode([text]) == [struct.pack(f"<{len(want)}I", *want)]


def test_rows(spark, odd, none, library):
    folder = shared_path(spark, "tokens")
    files = tf.write_files(odd, folder)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    got = tf.read_files(files, folder, schema, tf.summary).collect()
    want, rows = {}, odd.collect()
    for r in rows:
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 1]
        want.setdefault(r.doc_id, []).append((len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
    assert len(got) == len(rows)
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        want[r.doc_id].remove((r.n_tokens, r.ids_crc32))
        start += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start) if r.doc_id is not None]
    assert order == sorted(order)
    folder = shared_path(spark, "tokens")
    assert tf.read_files(tf.write_files(none, folder), folder, schema, tf.summary).count() == 0


def test_reader_takes_only_the_frames_it_needs(spark):
    docs = spark.range(400).selectExpr("id as doc_id", "concat('word ', id, repeat(' some more words', 200)) as text")
    folder = shared_path(spark, "tokens")
    files = tf.write_files(docs, folder, frame_ids=2000)
    got = tf.read_files(files, folder, "doc_id long, start long, n_tokens long, ids_crc32 long", tf.summary, [7, 200]).collect()
    assert sorted(r.doc_id for r in got) == [7, 200]


def make(n=50):
    out = Held()
    writer = tf.FileWriter(out, frame_ids=100)
    docs = [np.arange(i * 7 % 60, dtype="<u4") for i in range(n)]
    for i, ids in enumerate(docs):
        writer.add(i, ids.tobytes())
    writer.close()
    return Held(out.getvalue()), docs


def test_file_round_trip_and_partial_reads():
    file, docs = make()
    reader = tf.FileReader(file)
    assert len(reader.frames) > 5
    assert all((d.ids == docs[d.doc_id]).all() for d in reader.read())
    file.reads = 0
    (one,) = reader.read(np.array([33]))
    assert (one.ids == docs[33]).all() and one.before == sum(map(len, docs[:33]))
    assert file.reads <= int(reader.frames["packed"].max())


def test_frames_are_plain_zstandard():
    import zstandard

    file, docs = make()
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(file.getvalue()), read_across_frames=True).read()
    assert plain == b"".join(d.tobytes() for d in docs)


def test_damage_is_seen():
    file, _ = make()
    raw = bytearray(file.getvalue())
    raw[len(raw) - 9 - 4] ^= 1  # the checksum of the last frame in the seek table
    with pytest.raises(ValueError):
        list(tf.FileReader(Held(bytes(raw))).read())
    with pytest.raises(ValueError):
        tf.FileReader(Held(bytes(raw[:-1])))
