"""Periodic run detection in word sequences, by recursive frequency splitting and lag scans.

A run is a maximal stretch of words with smallest period q and at least max(LEAST, TIMES * q) words. Each of its words
occurs at least TIMES times in it. So a word that occurs less often within its segment (at first the whole text) lies
in no run: such words split the segment, the pieces are counted anew, and so on until no word goes. Ordinary prose
falls into pieces shorter than any run within a few rounds.

The pieces that are left are scanned at lags: a stretch where words q apart are identical is a run of period q if it is
long enough and q is not a multiple of a smaller period. Which lags can hold a run follows from blocks: if B / 2 < q <=
B (B a power of two), a run of period q holds a block of B words that begins at a multiple of B / 2, and the block's
next occurrence is exactly q further, as a primitive root occurs in its own square at its ends only (this takes four
periods, so TIMES may not be less). So each piece is
scanned at the distances of its blocks to their next occurrence, found by ranking blocks of doubling length; no lag
that holds a run is left out. All words of a batch of texts are ranked and split together.

Cases: null or empty text has no words and no runs; a text is handled whole, one text a step, however long; repeated
rows, rows without an id and rows that share one each get their row; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, table

#: A run has at least LEAST words and TIMES periods.
LEAST = 6
TIMES = 4
RUN = "array<struct<start: bigint, length: bigint, period: bigint>>"


def words_of(text: bytes | None) -> list[bytes]:
    """The maximal runs of bytes other than ASCII white space."""
    return (text or b"").split()


def split_segments(words: np.ndarray, texts: np.ndarray, times: int = TIMES, least: int = LEAST) -> list[tuple[int, int]]:
    """(start, end) of the pieces that frequency splitting leaves; ``texts`` numbers each word's text, in order."""
    at, segment = np.arange(len(words)), texts
    while len(at):
        pair = segment.astype(np.int64) * (int(words.max()) + 1) + words[at]
        _, place, count = np.unique(pair, return_inverse=True, return_counts=True)
        stays = count[place] >= times
        old = segment[stays]
        kept = at[stays]
        begins = np.r_[True, (np.diff(kept) > 1) | (np.diff(old) > 0)][: len(kept)]
        segment = np.cumsum(begins) - 1
        long = np.bincount(segment, minlength=1) >= least
        done = stays.all() and long.all()
        at, segment = kept[long[segment]], segment[long[segment]]
        if done:
            break
    if not len(at):
        return []
    first = np.flatnonzero(np.r_[True, np.diff(segment) > 0])
    return list(zip(at[first].tolist(), (at[np.r_[first[1:], len(at)] - 1] + 1).tolist(), strict=True))


def possible_lags(words: np.ndarray, times: int = TIMES) -> list[int]:
    """The lags at which a piece may hold a run (see the module)."""
    found: set[int] = set()
    rank, size = words, 1
    while size // 2 < len(words) // times and len(rank):
        order = np.argsort(rank, kind="stable")
        again = rank[order[1:]] == rank[order[:-1]]
        if not again.any():
            break  # no block of this length, so none longer, occurs twice
        here, lag = order[:-1][again], np.diff(order)[again]
        fits = (here % max(1, size // 2) == 0) & (lag > size // 2) & (lag <= size)
        found.update(np.unique(lag[fits]).tolist())
        pair = rank[: max(0, len(rank) - size)].astype(np.int64) * (int(rank.max()) + 1) + rank[size:]
        rank = np.unique(pair, return_inverse=True)[1] if len(pair) else pair
        size *= 2
    return sorted(q for q in found if times * q <= len(words))


def is_primitive(root: np.ndarray) -> bool:
    """Whether a word sequence is no repetition of a shorter one."""
    q, rest, d = len(root), len(root), 2
    while rest > 1:
        if d * d > rest:
            d = rest
        if rest % d == 0:
            if np.array_equal(root[q // d :], root[: q - q // d]):
                return False
            while rest % d == 0:
                rest //= d
        d += 1
    return True


def runs_in(words: np.ndarray, times: int = TIMES, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one piece."""
    out = []
    for q in possible_lags(words, times):
        same = np.r_[False, words[q:] == words[:-q], False]
        edges = np.flatnonzero(same[1:] != same[:-1])
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a + q >= max(least, times * q) and is_primitive(words[a : a + q]):
                out.append((a, b - a + q, q))
    return out


def text_runs(texts: list[list[bytes]], times: int = TIMES, least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """The runs of each text (a list of words), by start, then period."""
    if times < TIMES:
        raise ValueError(f"a run needs at least {TIMES} periods, not {times}")
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    lengths = np.array([len(t) for t in texts], np.int64)
    flat = np.empty(int(lengths.sum()), object)
    flat[:] = [w for t in texts for w in t]
    words = pd.factorize(flat)[0]
    ends = np.cumsum(lengths)
    numbers = np.repeat(np.arange(len(texts)), lengths)
    for a, b in split_segments(words, numbers, times, least):
        k = int(numbers[a])
        base = a - int(ends[k] - lengths[k])
        out[k].extend((base + s, n, q) for s, n, q in runs_in(words[a:b], times, least))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, without those that any run holds after its first period."""
    stays = np.ones(len(words), bool)
    for s, n, q in runs:
        stays[s + q : s + n] = False
    return b" ".join([words[k] for k in np.flatnonzero(stays).tolist()])


def detect(docs: DataFrame, times: int = TIMES, least: int = LEAST) -> DataFrame:
    """A row for each document: doc_id, n_words, runs (by start, then period), collapsed (the text without repeats)."""

    def run(batch):
        texts = [words_of(t) for t in batch.column("text").to_pylist()]
        runs = text_runs(texts, times, least)
        found = [[{"start": s, "length": n, "period": q} for s, n, q in each] for each in runs]
        return {
            "doc_id": batch.column("doc_id"),
            "n_words": pa.array([len(t) for t in texts], pa.int64()),
            "runs": pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
            "collapsed": pa.array([collapse(t, r) for t, r in zip(texts, runs, strict=True)], pa.binary()).cast(pa.string()),
        }

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return map_rows(rows, run, f"doc_id long, n_words long, runs {RUN}, collapsed string")


def plant(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words of the question's every tenth document (by a hash of doc_id) with a period; others, and rows without an id, as they are."""
    if doc_id is None or not words or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, every tenth text made periodic by :func:`plant`."""

    def run(batch):
        ids, texts = (batch.column(c).to_pylist() for c in ("doc_id", "text"))
        made = [t if (words := words_of(t)) is (new := plant(words, i)) else b" ".join(new) for i, t in zip(ids, texts, strict=True)]
        return {"doc_id": batch.column("doc_id"), "text": pa.array(made, pa.binary())}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return map_rows(rows, run, "doc_id long, text binary")


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; ties: smallest start, then period. Null without runs."""
    better = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]  # noqa: E731  (runs come by start, then period)
    return F.aggregate(runs, F.get(runs, 0), lambda best, r: F.when(better(r, best), r).otherwise(best))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every whole text of documents, every tenth made periodic first."""
    found = detect(planted(table(spark, sf_dir, "documents")))
    top = strongest(F.col("runs"))
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    return found.withColumn("top", top).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"top.{c}").alias(c) for c in ("start", "length", "period")),
        F.floor(1000 * F.col("top.length") / F.col("top.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
