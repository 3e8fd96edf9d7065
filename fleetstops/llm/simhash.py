"""SimHash near-dedup by anchor-point covering.

Fingerprints: a bit is set if it is set in over half of the hashes of a document's word shingles. Equal fingerprints
are one point from then on, so a group of copies of any size is one row.

Covering: the 64 bits are cut into blocks; two points at most ``threshold`` bits apart are at most
t = threshold // blocks apart in one block. In a block, anchors are the words of a covering code: a (15, 11) Hamming
code on 15 bits, every word on the rest, of covering radius 1. A point is sent to every anchor within radius + t of
its block. The anchor nearest to one point of a linked pair is then within radius + t of the other, so each linked
pair meets at an anchor, and no other pair need be looked at.

At an anchor, points are compared by exact distance, as a search that walks from linked point to linked point and
drops points once reached: a dense group costs one pass, and only the edges of a spanning star leave it. An anchor
with more than ``cell`` points is split: its points get one of s salts, and each pair of salts is a cell of its own,
so that every two points still meet. The stars are joined to components by alternating stars on Spark.

With three blocks of 21 or 22 bits a point goes to about 45 anchors, and a cell holds about 1/9,000 of all points. Two
blocks of 32 bits send a point to about 690 anchors and keep cells some ninety times smaller; that is the setting for
more than some billions of different fingerprints.

Cases: null or wordless text has fingerprint zero, linked like any other; fewer words than a shingle make one shingle
of all; repeated rows and ids all get a row; a null doc_id is never a component's id unless it has no other (then the
id is null); an empty table gives no rows.
"""

from __future__ import annotations

import functools
import itertools
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import keep_rows, map_rows, materialize, ship, table
from .components import components

#: Production parameters: words of a shingle, most differing bits of a link, hash seed.
SHINGLE, THRESHOLD, SEED = 4, 4, 42
#: Blocks of the covering; points of a cell beyond which it is split.
BLOCKS, CELL = 3, 8192

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text: str | None, words: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a text (A-Z lower-cased), as an unsigned number."""
    found = _WORD.findall((text or "").encode("utf-8", "replace").lower())
    if not found:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    hashes = [digest(join(found[i : i + words]), seed) for i in range(max(1, len(found) - words + 1))]
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = np.array(hashes[at : at + (1 << 14)], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, text_hash, fp): a row for each document; fp is the fingerprint's bits as a signed long."""

    def run(batch):
        fps = np.array([fingerprint(t, words, seed) for t in batch.column("text").to_pylist()], dtype=np.uint64)
        return {"doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "fp": pa.array(fps.view(np.int64))}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), F.col("text").cast("string").alias("text"))
    return map_rows(rows, run, "doc_id long, text_hash long, fp long")


def text_hash():
    """With doc_id, what names a row of documents."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


@functools.cache
def _hamming(reach: int) -> tuple[np.ndarray, np.ndarray]:
    """For each 15-bit word: the code words within ``reach`` of it (padded by repeating) and their distances.

    The code's words are those of syndrome zero: the positions (1 to 15) of their set bits cancel under XOR.
    """
    words = np.arange(1 << 15)
    syndrome = np.zeros(1 << 15, dtype=np.int64)
    for bit in range(15):
        syndrome ^= np.where(words >> bit & 1, bit + 1, 0)
    masks = [sum(1 << b for b in bits) for k in range(reach + 1) for bits in itertools.combinations(range(15), k)]
    near = [words[syndrome == syndrome[m]] for m in masks]  # adding mask m gives a code word
    found: list[list[tuple[int, int]]] = [[] for _ in range(1 << 15)]
    for mask, at in zip(masks, near, strict=True):
        for w in at:
            found[w].append((w ^ mask, mask.bit_count()))
    most = max(map(len, found))
    code = np.array([[c for c, _ in x] + [0] * (most - len(x)) for x in found], dtype=np.uint64)
    far = np.array([[d for _, d in x] + [99] * (most - len(x)) for x in found], dtype=np.int64)
    return code, far


def anchors(fps: np.ndarray, threshold: int = THRESHOLD, blocks: int = BLOCKS) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of all anchors each fingerprint is sent to; a cell's number holds block and anchor."""
    reach = 1 + threshold // blocks
    code, far = _hamming(reach)
    edges = [64 * k // blocks for k in range(blocks + 1)]
    rows, cells = [], []
    for block, (low, high) in enumerate(itertools.pairwise(edges)):
        value = fps >> np.uint64(low) & np.uint64((1 << (high - low)) - 1)
        head, rest = (value & np.uint64(0x7FFF)).astype(np.int64), value >> np.uint64(15)
        for k in range(reach + 1):
            masks = [sum(1 << b for b in bits) for bits in itertools.combinations(range(high - low - 15), k)]
            row, place = np.nonzero(far[head] <= reach - k)
            base = code[head[row], place]
            for mask in masks:
                rows.append(row)
                cells.append(base | (rest[row] ^ np.uint64(mask)) << np.uint64(15) | np.uint64(block) << np.uint64(48))
    return np.concatenate(rows), np.concatenate(cells)


def links(points: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what is connected among the points of one cell: (point, least point of its component)."""
    points = np.unique(points)
    if len(points) <= 256:
        near = np.bitwise_count(points[:, None] ^ points[None, :]) <= threshold
        if near.sum() == len(points):
            return points[:0], points[:0]
    ends, roots = [], []
    left = points
    while len(left):
        root, left = left[0], left[1:]
        wave = [root]
        while wave and len(left):
            near = np.bitwise_count(left ^ wave.pop()) <= threshold
            if near.any():
                ends.append(reached := left[near])
                roots.append(np.full(len(reached), root))
                wave.extend(reached)
                left = left[~near]
    return (np.concatenate(ends), np.concatenate(roots)) if ends else (points[:0], points[:0])


def _cells(points: DataFrame, threshold: int, blocks: int) -> DataFrame:
    def run(batch):
        fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        rows, cells = anchors(fps, threshold, blocks)
        return {"cell": pa.array(cells.view(np.int64)), "fp": pa.array(fps[rows].view(np.int64))}

    return map_rows(points.select("fp"), run, "cell long, fp long", rows=2048)


def _edges(sent: DataFrame, threshold: int) -> DataFrame:
    """Spanning edges of each cell, from rows sorted by cell; only one cell is held at a time."""
    ship(sent.sparkSession)

    def run(batches):
        held, cell = [], None

        def close():
            a, b = links(np.concatenate(held).view(np.uint64), threshold)
            return a.view(np.int64), b.view(np.int64)

        def out(pairs):
            a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            cells, salts = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "salt"))
            fps = batch.column("fp").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((cells[1:] != cells[:-1]) | (salts[1:] != salts[:-1])) + 1
            pairs = []
            for start, end in itertools.pairwise([0, *cuts.tolist(), len(cells)]):
                if start == end:
                    continue
                if (key := (cells[start], salts[start])) != cell:
                    if len(held) > 1 or held and len(held[0]) > 1:
                        pairs.append(close())
                    held, cell = [], key
                held.append(fps[start:end])
            held = [np.concatenate(held)] if held else held
            if any(len(a) for a, _ in pairs):
                yield out(pairs)
        if held and len(held[0]) > 1:
            yield out([close()])

    return sent.mapInArrow(run, "a long, b long")


def near_links(points: DataFrame, threshold: int = THRESHOLD, blocks: int = BLOCKS, cell: int = CELL) -> DataFrame:
    """Edges (a, b) that connect all fingerprints (column fp, distinct) linked at ``threshold`` bits."""
    sent = materialize(_cells(points, threshold, blocks), "anchors")
    large = sent.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cell)
    large = large.select(F.col("cell").alias("of"), F.ceil(F.col("n") / F.lit(cell)).cast("int").alias("salts"))
    # A point of a split cell goes to the cells of its salt with each other one: all pairs of salts are compared.
    salted = sent.join(large, F.col("cell") == F.col("of"), "left")
    own = F.pmod(F.xxhash64("fp"), F.coalesce(F.col("salts"), F.lit(1))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1))
    salted = salted.withColumn("own", own).withColumn("other", other)
    salt = (F.least("own", "other") * F.lit(1 << 20) + F.greatest("own", "other")).alias("salt")
    dealt = salted.select("cell", salt, "fp").repartition("cell", "salt").sortWithinPartitions("cell", "salt")
    return _edges(dealt, threshold)


def groups(docs: DataFrame, words: int = SHINGLE, threshold: int = THRESHOLD, seed: int = SEED, blocks: int = BLOCKS) -> DataFrame:
    """A row for each document: doc_id, text_hash, fp, root (one fingerprint of the component), component_id (the
    smallest doc_id that its links reach)."""
    found = materialize(fingerprints(docs, words, seed), "fingerprints")
    points = found.groupBy("fp").agg(F.min("doc_id").alias("least"))
    linked = components(near_links(points.select("fp"), threshold, blocks))
    roots = points.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = roots.select("fp", "root").join(ids, "root").select("fp", "root", "component_id")
    return found.join(ids, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component: that of the smallest doc_id, with all columns.

    Null ids come last; of rows that share doc_id, the one of the least text hash stays.
    """
    found = groups(docs, **how).groupBy("root", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("times"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "times"))
    least = found.groupBy("root").agg(first.alias("r")).select("r.doc_id", "r.text_hash", "r.times")
    return keep_rows(docs, least, {"doc_id": F.col("doc_id").cast("long"), "text_hash": text_hash()})


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    found = groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
