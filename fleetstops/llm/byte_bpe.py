"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is encoded as a tree: halves are encoded on their own, and two encoded neighbours are joined by encoding a
window across their border again, growing it until the tokens outside can't change. Two levels prove that:

* Between pre-tokens: the pattern never takes white space after another character into one match, and a match
  depends on no text before it. So a border between a word character and a space or line feed is one in any context,
  and a window between two such borders (the last in the left half, the first in the right) settles the join.
* Inside a pre-token too long for one call: a sequence of tokens is the encoding of its bytes exactly if each two
  neighbours are the encoding of theirs. A window settles the join once its first and last token stand the test with
  the tokens beside it.

Decoding concatenates bytes up the tree. Long texts and long unbroken runs thus cost near-linear time.

Cases: null text counts as empty; an empty text has no ids; special tokens' strings are ordinary text; every row is
encoded, repeated ones and null ids too; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import functools
import re

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, table

#: The vocabulary's file; a parameter of every function here.
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

#: Characters of a leaf of the text tree, bytes of a leaf inside one pre-token, ids of a leaf when decoding.
LEAF_CHARS, LEAF_BYTES, LEAF_IDS = 4096, 256, 1024

#: A border in any context stands after such a match.
_BORDER = re.compile(r"[^\W_](?=[ \n])")


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str = RANKS, leaf_chars: int = LEAF_CHARS, leaf_bytes: int = LEAF_BYTES):
        import regex
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.leaf_chars, self.leaf_bytes = leaf_chars, leaf_bytes
        self._leaf = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._words = regex.compile(public_tokenizers.PATTERN)
        self._fits = functools.lru_cache(1 << 16)(self._fit)

    def encode(self, text: str) -> list[int]:
        return self._tree(text, 0, len(text))

    def _tree(self, text: str, start: int, end: int) -> list[int]:
        if end - start <= self.leaf_chars:
            return self._leaf.encode_ordinary(text[start:end])
        middle = (start + end) // 2
        left, right = self._tree(text, start, middle), self._tree(text, middle, end)
        begin, stop = self._last_border(text, start, middle), self._first_border(text, middle, end)
        tail, head = self._window(text[begin:middle]), self._window(text[middle:stop])
        return left[: len(left) - len(tail)] + self._window(text[begin:stop]) + right[len(head) :]

    def _last_border(self, text: str, start: int, middle: int) -> int:
        """The last sure border in [start, middle), looked for in growing windows; none: start."""
        reach = 64
        while True:
            at = max(start, middle - reach)
            found = None
            for found in _BORDER.finditer(text, at, middle):
                pass
            if found or at == start:
                return found.end() if found else start
            reach *= 4

    def _first_border(self, text: str, middle: int, end: int) -> int:
        """The first sure border in (middle, end]; none: end. One character more is read for the look-ahead."""
        found = _BORDER.search(text, middle, min(len(text), end + 1))
        return min(found.end(), end) if found else end

    def _window(self, text: str) -> list[int]:
        """A window's ids; beyond a leaf's length it may hold pre-tokens of any length."""
        if len(text) <= self.leaf_chars:
            return self._leaf.encode_ordinary(text)
        out: list[int] = []
        for match in self._words.finditer(text):
            piece = match[0].encode("utf-8", "replace")
            out += self._piece(piece, 0, len(piece))
        return out

    def _piece(self, piece: bytes, start: int, end: int) -> list[int]:
        """Ids of bytes within one pre-token."""
        if end - start <= self.leaf_bytes:
            return self._one(piece[start:end])
        middle = (start + end) // 2
        return self._join(self._piece(piece, start, middle), self._piece(piece, middle, end))

    def _join(self, left: list[int], right: list[int]) -> list[int]:
        reach = 1
        while True:
            a, b = max(0, len(left) - reach), min(len(right), reach)
            window = self._one(b"".join(map(self.bytes_of.__getitem__, left[a:] + right[:b])))
            stable = not a or self._fits(left[a - 1], window[0])
            if stable and (b == len(right) or self._fits(window[-1], right[b])):
                return left[:a] + window + right[b:]
            reach *= 2

    def _one(self, piece: bytes) -> list[int]:
        return self._leaf._encode_single_piece(piece)

    def _fit(self, a: int, b: int) -> bool:
        """Whether a, b is the encoding of its bytes."""
        return self._one(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_IDS:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


@functools.lru_cache(2)
def coder(path: str) -> ByteBpe:
    """One encoder a worker process and file."""
    return ByteBpe(path)


def encode_decode(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """A row for each document: doc_id, ids (array of int), decoded (the decoded bytes)."""

    def run(batch):
        own = coder(path)
        ids = [own.encode(t or "") for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "ids": ids, "decoded": [own.decode(x) for x in ids]}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_rows(rows, run, "doc_id long, ids array<int>, decoded binary")


def digests() -> list:
    """n_tokens, ids_sha256 (of the decimal ids joined by commas) and decoded_sha256, from ids and decoded."""
    return [
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    ]


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes every whole text of documents."""
    return encode_decode(table(spark, sf_dir, "documents")).select("doc_id", *digests())
