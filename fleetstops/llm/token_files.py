"""Token ids as seekable binary files: independent zstandard frames, a trailing seek table, checksums per frame.

A file holds the ids of whole documents in ascending doc_id order as little-endian unsigned 32-bit integers. Its
frames are zstandard frames that need no other; each ends with its own content checksum and holds one document or
more up to about FRAME_IDS ids. After them stand two skippable frames: first the document table (doc_id, number of
ids, frame of each document), last the seek table in the public seekable layout (compressed size, decompressed size
and checksum of each frame; footer with the number of frames). A reader takes the tail, then only the frames it needs.

Documents are dealt to tasks by ranges of doc_id, so files follow one another in ascending order and no task holds
more than its range. A task writes a file under a name of its own and reports it in its result; that report, kept as
a Parquet table in the shared folder, is the list of files, so a task that runs twice after a lost executor leaves a
file that nobody reads, and no other harm. Ids before a document: ids before its file (a running sum of one row for
each file) plus ids before it in the file.

Cases: null text counts as empty and holds the end id alone; rows that share a doc_id all stay, in an order fixed by
their text; null doc_ids come first; an empty table gives no files and no rows.
"""

from __future__ import annotations

import functools
import itertools
import json
import re
import struct
import sys
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import materialize, shared_path, ship, table

#: The tokenizer's file and the id that ends each document: parameters.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1
#: About how many ids a frame holds (a document is never split), and the compression level.
FRAME_IDS = 1 << 16
LEVEL = 1
#: Words, and as many pre-tokens, whose ids a worker process remembers before it starts anew.
WORDS_KEPT = 500_000

#: Fixed values of the public formats: magic numbers of the two skippable frames and of the seek table's footer.
SEEK_FRAME, TABLE_FRAME, SEEK_MAGIC = 0x184D2A5E, 0x184D2A5D, 0x8F92EAB1

_DOC = np.dtype([("doc_id", "<i8"), ("n", "<u4"), ("frame", "<u4"), ("null", "u1")])
_ENTRY = np.dtype([("packed", "<u4"), ("plain", "<u4"), ("sum", "<u4")])


def _byte_of() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable Latin-1 stands for itself, the rest follow
    in order from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(1)
def _unassigned() -> re.Pattern:
    """Matches a code point that this Python's Unicode data has not assigned: other tables may know it as a letter."""
    known = [unicodedata.category(chr(c)) != "Cn" for c in range(sys.maxunicode + 1)]
    edges = [c for c in range(1, len(known)) if known[c] != known[c - 1]] + [len(known)]
    gaps = [(a, b - 1) for a, b in zip(edges, edges[1:], strict=False) if not known[a]]
    return re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in gaps) + "]")


class _Foreign(Exception):
    """A word holds a code point that the rank table isn't proven for."""


class WordTokenizer:
    """The ids of whole texts as little-endian 32-bit integers, as the tokenizers library gives them.

    A text is normalised and cut into pre-tokens as the file says; ids of words and pre-tokens met before come from
    tables of bounded size, new ones from the file's merges. Where ids rise in the order of the merges, as in the given file,
    those run as a rank table over bytes, a NUL byte standing for the end of a word: three times as fast as the
    library's own. Texts that hold NUL, may hold a special token's string or hold a code point that Python's Unicode data
    doesn't know, and files of another kind, go whole through the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._own = Tokenizer.from_file(path)
        self._known: dict[str, bytes] = {}
        self._words: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        self._ranks = self._rank_table(said)
        self._special = [t["content"] for t in said["added_tokens"]]
        pattern = _split_pattern(said)
        if self._ranks and pattern:
            import regex
            import tiktoken

            self._cut = regex.compile(pattern)
            self._bpe = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=self._ranks, special_tokens={})
        else:
            self._ranks = None

    @staticmethod
    def _rank_table(said: dict) -> dict[bytes, int] | None:
        """Bytes of each token to its id, if merging the lowest id first is what the file's merges do."""
        model = said["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>" or model.get("continuing_subword_prefix"):
            return None
        vocab, byte = model["vocab"], _byte_of()
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        ends = [vocab.get(c + "</w>", -1) for c in byte]
        if min(ends) < 0 or merged != sorted(merged) or merged[0] < max(ends):
            return None
        special = {t["content"] for t in said["added_tokens"]}
        cut = ((t.removesuffix("</w>"), t.endswith("</w>"), i) for t, i in vocab.items() if t not in special)
        return {bytes(byte[c] for c in t) + b"\0" * end: i for t, end, i in cut}

    def encode(self, texts: list[str]) -> list[bytes]:
        return list(map(self._encode, texts))

    def by_table(self, text: str) -> bool:
        """Whether the rank table gives the library's ids for this text: proven for all other code points."""
        return self._may(text) and not _unassigned().search(text)

    def _may(self, text: str) -> bool:
        return bool(self._ranks) and "\0" not in text and not any(t in text for t in self._special)

    def _encode(self, text: str) -> bytes:
        if self._may(text):
            try:
                return self._by_words(text)
            except _Foreign:
                pass
        ids = self._own.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _by_words(self, text: str) -> bytes:
        if not text.isascii():
            # A capital sigma becomes a plain small one wherever it stands.
            text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")
        # No pre-token holds a space or line feed: what stands between them is looked up whole.
        words, known = text.lower().replace("\n", " ").split(" "), self._words
        try:
            return b"".join([known[word] for word in words])
        except KeyError:
            return b"".join([known[word] if word in known else self._word(word) for word in words])

    def _word(self, word: str) -> bytes:
        # Asked of new words only: those that are kept have passed.
        if not word.isascii() and _unassigned().search(word):
            raise _Foreign
        if len(self._words) >= WORDS_KEPT:
            self._words.clear()
        known = self._known
        self._words[word] = found = b"".join([known.get(piece) or self._learn(piece) for piece in self._cut.findall(word)])
        return found

    def _learn(self, piece: str) -> bytes:
        if len(self._known) >= WORDS_KEPT:
            self._known.clear()
        ids = self._bpe._encode_single_piece(piece.encode("utf-8", "replace") + b"\0")
        self._known[piece] = found = struct.pack(f"<{len(ids)}I", *ids)
        return found


def _split_pattern(said: dict) -> str | None:
    """The pattern whose matches are the pre-tokens, if the file normalises and splits in the known way."""
    steps = [(n["type"], n.get("pattern", {}).get("Regex")) for n in (said["normalizer"] or {}).get("normalizers", [])]
    cuts = (said["pre_tokenizer"] or {}).get("pretokenizers", [])
    if steps != [("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)] or [c["type"] for c in cuts] != ["Split", "ByteLevel"]:
        return None
    split, level = cuts
    plain = split["invert"] and split["behavior"] == "Removed" and not level["add_prefix_space"] and not level["use_regex"]
    return split["pattern"].get("Regex") if plain else None


@functools.lru_cache(2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


class FileWriter:
    """Writes one file frame by frame; memory holds one frame and the tables."""

    def __init__(self, out, frame_ids: int = FRAME_IDS):
        self._out, self._most = out, 4 * frame_ids
        self._pack = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
        self._held, self._size = [], 0
        self._docs, self._frames = [], []
        self.ids = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self._size and self._size + len(ids) > self._most:
            self._flush()
        self._docs.append((doc_id or 0, len(ids) // 4, len(self._frames), doc_id is None))
        self._held.append(ids)
        self._size += len(ids)
        self.ids += len(ids) // 4

    def _flush(self) -> None:
        if self._held:
            plain = b"".join(self._held)
            packed = self._pack.compress(plain)
            self._out.write(packed)
            self._frames.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
            self._held, self._size = [], 0

    def close(self) -> int:
        """Finish the file; returns the number of documents."""
        self._flush()
        docs = np.array(self._docs, dtype=_DOC).tobytes()
        self._out.write(struct.pack("<II", TABLE_FRAME, len(docs) + 4) + docs + struct.pack("<I", len(self._docs)))
        entries = np.array(self._frames, dtype=_ENTRY).tobytes()
        # Footer: number of frames, a descriptor whose top bit says that entries hold checksums, the magic number.
        self._out.write(struct.pack("<II", SEEK_FRAME, len(entries) + 9) + entries + struct.pack("<IBI", len(self._frames), 0x80, SEEK_MAGIC))
        return len(self._docs)


@dataclass
class Stored:
    """A document in a file: its place among the file's documents, ids before it in the file, its ids."""

    doc_id: int | None
    before: int
    ids: np.ndarray


class FileReader:
    """Reads a file's tables from its tail and decompresses only the frames of the documents asked for."""

    def __init__(self, source):
        self._in = source
        end = source.size()
        n, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEK_MAGIC or flags != 0x80:
            raise ValueError("no seek table at the end of the file")
        at = end - 9 - n * _ENTRY.itemsize
        self.frames = np.frombuffer(self._at(at, n * _ENTRY.itemsize), _ENTRY)
        self._starts = np.concatenate([[0], np.cumsum(self.frames["packed"], dtype=np.int64)])
        body = int(self._starts[-1])
        magic, size = struct.unpack("<II", self._at(body, 8))
        if magic != TABLE_FRAME:
            raise ValueError("no document table after the frames")
        self.docs = np.frombuffer(self._at(body + 8, size - 4), _DOC)
        self._before = np.concatenate([[0], np.cumsum(self.docs["n"], dtype=np.int64)])
        self._unpack = zstandard.ZstdDecompressor()

    def _at(self, place: int, size: int) -> bytes:
        self._in.seek(place)
        return self._in.read(size)

    def frame(self, k: int) -> np.ndarray:
        """The ids of frame k, checked against both checksums."""
        plain = self._unpack.decompress(self._at(int(self._starts[k]), int(self.frames["packed"][k])))
        if len(plain) != self.frames["plain"][k] or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.frames["sum"][k]:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(plain, "<u4")

    def read(self, wanted: np.ndarray | None = None) -> Iterator[Stored]:
        """All documents, or those whose ids are in ``wanted``, in the file's order."""
        which = np.arange(len(self.docs)) if wanted is None else np.flatnonzero(np.isin(self.docs["doc_id"], wanted) & (self.docs["null"] == 0))
        held, ids, base = -1, None, 0
        for i in which:
            doc = self.docs[i]
            if doc["frame"] != held:
                held = int(doc["frame"])
                ids, base = self.frame(held), int(self._before[np.searchsorted(self.docs["frame"], held)])
            start = int(self._before[i]) - base
            yield Stored(None if doc["null"] else int(doc["doc_id"]), int(self._before[i]), ids[start : start + int(doc["n"])])


def write_files(docs: DataFrame, folder: str, path: str = TOKENIZER, end_id: int = END_ID, frame_ids: int = FRAME_IDS) -> DataFrame:
    """Write all documents as files below ``folder``; returns the list of files (file, docs, ids, before)."""
    ship(docs.sparkSession)
    end = struct.pack("<I", end_id)

    def run(batches):
        writer = out = name = None
        own = tokenizer(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                if writer is None:
                    store, root = pa.fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
                    store.create_dir(root)
                    name = f"{uuid.uuid4().hex}.ids"
                    out = store.open_output_stream(f"{root}/{name}")
                    writer = FileWriter(out, frame_ids)
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), own.encode([t or "" for t in part.column("text").to_pylist()]), strict=True):
                    writer.add(doc_id, ids + end)
        if writer is not None:
            n = writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "docs": pa.array([n], pa.int64()), "ids": pa.array([writer.ids], pa.int64())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    written = dealt.select("doc_id", "text").mapInArrow(run, "file string, docs long, ids long")
    files = materialize(written.withColumn("part", F.spark_partition_id()), "token-files")
    # One row for each file: a running sum in the order of the ranges.
    before = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return files.select("part", "file", "docs", "ids", F.coalesce(before, F.lit(0)).alias("before"))


def read_files(files: DataFrame, folder: str, schema: str, make, wanted: list[int] | None = None) -> DataFrame:
    """A row made by ``make(document, ids before it)`` for each stored document, all or those in ``wanted``."""
    ship(files.sparkSession)
    kind = to_arrow_schema(StructType.fromDDL(schema))
    ask = None if wanted is None else np.array(wanted, dtype=np.int64)

    def run(batches):
        for batch in batches:
            for name, before in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist(), strict=True):
                store, root = pa.fs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
                with store.open_input_file(f"{root}/{name}") as source:
                    found = (make(doc, before + doc.before) for doc in FileReader(source).read(ask))
                    while rows := list(itertools.islice(found, 1024)):
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kind, strict=True)], schema=kind)

    # Files are dealt by name; a stated number of partitions is kept, so that small lists of large files spread too.
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("file", "before").repartition(tasks, "file").mapInArrow(run, schema)


def summary(doc: Stored, start: int) -> tuple:
    """doc_id, start, n_tokens and the CRC of the ids as little-endian unsigned 32-bit integers."""
    return doc.doc_id, start, len(doc.ids), zlib.crc32(doc.ids.astype("<u4").tobytes())


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents as token files and returns, read back, where each document's ids are."""
    folder = shared_path(spark, "tokens")
    files = write_files(table(spark, sf_dir, "documents"), folder)
    return read_files(files, folder, "doc_id long, start long, n_tokens long, ids_crc32 long", summary)
