"""Suffix-array dedup: bytes covered by a string of LENGTH bytes that also starts earlier, by distributed prefix doubling.

The rank of a position stands for its first k bytes: positions have equal ranks if those are equal. Ranks of 8 bytes
come from the bytes, ranks of longer prefixes from the pair (rank, rank at a growing offset), as in prefix doubling;
a pair's rank is a 64-bit mix of it, so that ranks need no table of all pairs. Rounds take the prefix lengths of
LADDER up to LENGTH. In each round Spark sorts by rank; positions whose rank nothing else has are unique and leave,
those that repeat an earlier position in full are decided, and only the rest is ranked anew in the next round.

What is sorted are not single positions. All windows (strings of LENGTH bytes) that share their least rank of k bytes
and follow one another are one row, a segment: its rank is that least rank, its phrase the segment's whole text. Equal
windows have equal least ranks, so windows of segments with different ranks differ. Among segments of one rank:

* only one phrase, once: unique, all its windows leave (unless a window could occur twice inside, see ``tied``);
* the same phrase as an earlier segment: all its windows repeat an earlier one;
* the first segment of each phrase, where a rank has several: open, goes to the next round with its own bytes.

Segments get shorter as k grows; in the last round each is one window and its rank that of the whole string. Phrases
are told apart within a rank only, so two 64-bit values must agree before anything counts as equal.

A task keeps one row of each phrase before rows move (the others in its batch are decided at once), so a text held by
a third of all rows is one row a batch. Where a batch holds several phrases of a rank, it deals them by rank and phrase
and sends one further row to the rank's own group, as a sign that the rank is open; no group gets more than two rows
of a batch. Texts move twice, compressed: to cut the bytes of the first open segments, and to cut what is removed.

Cases: null text is empty; texts shorter than LENGTH have no window; positions are ordered by doc_id, rows without one
last, then by a hash of the text; of rows that share doc_id and text, all but one repeat it and lose all bytes (if they
have LENGTH); texts of any length are ranked in steps of STEP windows; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_rows, materialize, ship, table

#: Strings of so many bytes count; the prefix lengths of the rounds (8 or more each, the last one is LENGTH).
LENGTH = 100
LADDER = (32, 64, 84, LENGTH)
#: Windows ranked in one step (about 100 bytes of memory each; arrays that fit a core's cache are ranked fastest).
STEP = 1 << 17
#: What a row says: one phrase of its rank in its batch; one of several; decided; a sign that a rank is open.
PLAIN, SEVERAL, DECIDED, SIGN = range(4)
LAST = (1 << 63) - 1
#: A segment's place: its start, and in the low bits its number of windows.
PLACE_BITS = 16


def scramble(z: np.ndarray) -> np.ndarray:
    """Spreads a number's bits, in place; different numbers stay different."""
    z ^= z >> np.uint64(32)
    z *= np.uint64(0xD6E8FEB86659FD93)
    z ^= z >> np.uint64(29)
    return z


def mix(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The rank of pairs of ranks."""
    z = x * np.uint64(0x9E3779B97F4A7C15)
    z += y
    return scramble(z)


def doubled_ranks(text: np.ndarray, most: int) -> dict[int, np.ndarray]:
    """Ranks of the first 8, 16, 32, ... bytes, up to ``most``, at each position that has so many."""
    n = max(0, len(text) - 7)
    first = np.empty(n, np.uint64)
    for r in range(min(8, n)):
        words = np.frombuffer(text[r : r + (len(text) - r) // 8 * 8].tobytes(), "<u8")
        first[r::8] = words[: len(first[r::8])]
    first *= np.uint64(0xC2B2AE3D27D4EB4F)
    ranks, size = {8: scramble(first)}, 8
    while 2 * size <= most:
        x = ranks[size]
        ranks[2 * size] = mix(x[: max(0, len(x) - size)], x[size:])
        size *= 2
    return ranks


def prefix_ranks(ranks: dict[int, np.ndarray], size: int) -> np.ndarray:
    """Ranks of the first ``size`` bytes: the pair of two of the next smaller doubled size, at the offset that is left."""
    half = max(k for k in ranks if k <= size)
    x = ranks[half]
    return x if half == size else mix(x[: max(0, len(x) - (size - half))], x[size - half :])


def sliding(least, x: np.ndarray, width: int) -> np.ndarray:
    """np.minimum or np.maximum over each ``width`` neighbours, by doubling."""
    size = 1
    while 2 * size <= width:
        x = least(x[: max(0, len(x) - size)], x[size:])
        size *= 2
    rest = width - size
    return least(x[: max(0, len(x) - rest)], x[rest:]) if rest else x


def tied(own: np.ndarray, least: np.ndarray, width: int) -> np.ndarray:
    """Marks windows that may hold their least rank twice, without which no two windows of a segment are equal.

    Two places of one least rank, closer than a window, follow one another among the places that are the least of any
    window: one between them would be less than neither.
    """
    edge = np.zeros(width - 1, np.uint64)
    places = np.flatnonzero(sliding(np.maximum, np.r_[edge, least, edge], width) == own)
    a, b = places[:-1], places[1:]
    twice = (own[a] == own[b]) & (b - a < width)
    change = np.zeros(len(least) + 1, np.int64)
    np.add.at(change, np.maximum(b[twice] - width + 1, 0), 1)
    np.add.at(change, np.minimum(a[twice] + 1, len(least)), -1)
    return np.cumsum(change[:-1]) > 0


def segments(pieces: list[bytes], size: int, length: int, first: int) -> dict[str, np.ndarray]:
    """The segments of the pieces' windows at prefix length ``size``: piece, start, n (windows), rank, phrase, tie.

    ``first`` is the first round's prefix length: in the last round, where rank and phrase would be the same, the
    phrase is the least rank of that length.
    """
    text = np.frombuffer(b"".join(pieces), np.uint8)
    lengths = np.array([len(p) for p in pieces], np.int64)
    counts = np.maximum(lengths - length + 1, 0)
    total = int(counts.sum())
    if not total:
        none = np.zeros(0, np.int64)
        return {"piece": none, "start": none, "n": none, "rank": none.astype(np.uint64), "phrase": none.astype(np.uint64), "tie": none.astype(bool)}
    begins = np.cumsum(lengths) - lengths
    piece = np.repeat(np.arange(len(pieces)), counts)
    at = np.arange(total) + np.repeat(begins - (np.cumsum(counts) - counts), counts)
    ranks = doubled_ranks(text, length)
    whole = prefix_ranks(ranks, length)
    if size == length:
        phrase = sliding(np.minimum, prefix_ranks(ranks, first), length - first + 1)
        return {"piece": piece, "start": at - begins[piece], "n": np.ones(total, np.int64), "rank": whole[at], "phrase": phrase[at], "tie": np.zeros(total, bool)}
    own, width = prefix_ranks(ranks, size), length - size + 1
    least = sliding(np.minimum, own, width)
    rank = least[at]
    new = np.r_[True, (rank[1:] != rank[:-1]) | (piece[1:] != piece[:-1])]
    run = np.flatnonzero(new)
    new |= (np.arange(total) - run[np.cumsum(new) - 1]) % length == 0  # so that a phrase's first and last window cover it
    begin = np.flatnonzero(new)
    n = np.diff(np.r_[begin, total])
    phrase = mix(mix(whole[at[begin]], whole[at[begin + n - 1]]), n.astype(np.uint64))
    tie = np.logical_or.reduceat(tied(own, least, width)[at], begin)
    return {"piece": piece[begin], "start": at[begin] - begins[piece[begin]], "n": n, "rank": rank[begin], "phrase": phrase, "tie": tie}


def steps(pieces: list[tuple[int, bytes]], length: int):
    """Lists of (number, start, bytes) with at most STEP windows a list; longer pieces are cut, windows are not."""
    held, size = [], 0
    for number, piece in pieces:
        for start in range(0, max(0, len(piece) - length + 1), STEP):
            part = piece[start : start + STEP + length - 1] if len(piece) > STEP else piece
            if held and size + len(part) > STEP:
                yield held
                held, size = [], 0
            held.append((number, start, part))
            size += len(part)
    if held:
        yield held


def batch_rows(ids: np.ndarray, ties: np.ndarray, starts: np.ndarray, texts: list[bytes], size: int, length: int, first: int, carry: bool) -> dict:
    """The rows that a batch of pieces sends: one of each phrase, the decided ones, the signs of open ranks."""
    found, bodies = [], []
    for held in steps(list(enumerate(texts)), length):
        got = segments([part for _, _, part in held], size, length, first)
        own = np.array([number for number, _, _ in held])[got["piece"]]
        begin = np.array([start for _, start, _ in held])[got["piece"]] + got["start"]
        found.append((own, begin, got["n"], got["rank"], got["phrase"], got["tie"]))
    if not found:
        found = [tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, bool))]
    own, begin, n, rank, phrase, tie = map(np.concatenate, zip(*found, strict=True))
    place = (starts[own] + begin) << PLACE_BITS | n
    order = np.lexsort((place, ties[own], ids[own], phrase, rank))
    own, begin, n, rank, phrase, tie, place = (x[order] for x in (own, begin, n, rank, phrase, tie, place))
    id_, text_tie = ids[own], ties[own]

    same_rank = np.r_[False, rank[1:] == rank[:-1]][: len(rank)]
    new = ~(same_rank & np.r_[False, phrase[1:] == phrase[:-1]][: len(rank)])
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(rank) else np.zeros(0, int)
    itself = ~new & (id_ == id_[head]) & (text_tie == text_tie[head]) & (place == place[head])
    decided = ~new & ~itself
    # Ranks with several phrases, or with a tie, in this batch. In the last round a phrase is one window.
    number = np.cumsum(~same_rank) - 1
    several = np.zeros(len(rank), bool)
    if size < length and len(rank):
        several = ((np.bincount(number, weights=new) > 1) | (np.bincount(number, weights=tie) > 0))[number]
    deal = np.where(several, mix(rank, phrase), rank)
    deal[decided] = mix(mix(text_tie.view(np.uint64), id_.view(np.uint64)), place.view(np.uint64))[decided]
    state = np.where(decided, DECIDED, np.where(several, SEVERAL, PLAIN))
    sent = np.flatnonzero(new | decided)
    sign = np.flatnonzero(several & ~same_rank)

    def column(values, signs, kind):
        return pa.array(np.r_[values[sent], signs].astype(kind) if kind else [], pa.int64())

    last = np.full(len(sign), LAST)
    out = {
        "deal": column(deal.view(np.int64), rank.view(np.int64)[sign], np.int64),
        "phrase": column(phrase.view(np.int64), phrase.view(np.int64)[sign], np.int64),
        "id": column(id_, last, np.int64),
        "tie": column(text_tie, last, np.int64),
        "place": column(place, last, np.int64),
        "state": pa.array(np.r_[state[sent], np.full(len(sign), SIGN)], pa.int32()),
    }
    if carry:
        bodies = [None if decided[k] else texts[own[k]][begin[k] : begin[k] + n[k] + length - 1] for k in sent.tolist()]
        out["body"] = pa.array(bodies + [None] * len(sign), pa.binary())
    return out


def _round(pieces: DataFrame, size: int, ladder: tuple[int, ...]) -> DataFrame:
    """(id, tie, place, open, body) of the segments that repeat an earlier one (open false) or stay open.

    ``pieces``: id, tie, start, text (binary).
    """
    length, first = ladder[-1], ladder[0]
    carry = first < size < length
    schema = "deal long, phrase long, id long, tie long, place long, state int" + ", body binary" * carry
    ship(pieces.sparkSession)

    def run(batches):
        for batch in batches:
            ids, ties, starts = (batch.column(c).to_numpy() for c in ("id", "tie", "start"))
            out = batch_rows(ids, ties, starts, batch.column("text").to_pylist(), size, length, first, carry)
            yield pa.RecordBatch.from_pydict(out)

    rows = pieces.select("id", "tie", "start", "text").mapInArrow(run, schema).repartition("deal")
    order = ["phrase", "id", "tie", "place"]
    group = Window.partitionBy("deal").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.partitionBy("deal", "phrase").orderBy(*order[1:])
    is_open = (F.col("state") == SEVERAL) | (F.first("phrase").over(group) != F.last("phrase").over(group)) | (F.max("state").over(group) == SIGN)
    told = rows.withColumn("open", is_open & F.lit(size < length)).withColumn("nth", F.rank().over(before))
    repeat = (F.col("nth") > 1) | (F.col("state") == DECIDED)
    told = told.filter((F.col("state") != SIGN) & (repeat | F.col("open")))
    body = F.when(~repeat, F.col("body")) if carry else F.lit(None).cast("binary")
    return materialize(told.select("id", "tie", "place", (~repeat).alias("open"), body.alias("body")), f"repeats-{size}")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (binary, not null), id and tie, by which positions are ordered."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    doc_id = F.col("doc_id").cast("long")
    keyed = docs.select(doc_id.alias("doc_id"), text.alias("text"), F.coalesce(doc_id, F.lit(LAST)).alias("id"))
    return keyed.withColumn("tie", F.xxhash64("text", F.col("doc_id").isNull()))


def _packed(keyed: DataFrame) -> DataFrame:
    """One row of each (id, tie): doc_id, the text compressed, and how many rows have it."""

    def run(batch):
        pack = zstandard.ZstdCompressor(level=3).compress
        return {c: batch.column(c) for c in ("doc_id", "id", "tie")} | {"packed": pa.array([pack(t) for t in batch.column("text").to_pylist()], pa.binary())}

    rows = map_rows(keyed, run, "doc_id long, id long, tie long, packed binary")
    return rows.groupBy("id", "tie").agg(F.first("doc_id").alias("doc_id"), F.first("packed").alias("packed"), F.count(F.lit(1)).alias("times"))


def _places(rows: DataFrame) -> DataFrame:
    """(id, tie, places): a document's places are as many as it has segments at most."""
    return rows.groupBy("id", "tie").agg(F.collect_set("place").alias("places"))


def _cut_open(packed: DataFrame, found: DataFrame, length: int) -> DataFrame:
    """The bytes of the first round's open segments: id, tie, start, text."""

    def run(batch):
        unpack, out = zstandard.ZstdDecompressor().decompress, {"id": [], "tie": [], "start": [], "text": []}
        for i, t, p, places in zip(*(batch.column(c).to_pylist() for c in ("id", "tie", "packed", "places")), strict=True):
            text = unpack(p)
            for place in places:
                start, n = place >> PLACE_BITS, place & (1 << PLACE_BITS) - 1
                for c, v in zip(out, (i, t, start, text[start : start + n + length - 1]), strict=True):
                    out[c].append(v)
        return out

    rows = packed.select("id", "tie", "packed").join(_places(found.filter("open")), ["id", "tie"])
    return map_rows(rows, run, "id long, tie long, start long, text binary")


def covered(places: list[int] | None, length: int) -> list[tuple[int, int]]:
    """Maximal (start, end) of the bytes that the windows at these places cover."""
    out: list[list[int]] = []
    for place in sorted(places or []):
        start = place >> PLACE_BITS
        end = start + (place & (1 << PLACE_BITS) - 1) + length - 1
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, ladder: tuple[int, ...] = LADDER) -> DataFrame:
    """A row for each document: doc_id, n_bytes, spans (array of start, end: the removed runs), kept (the other bytes).

    ``ladder``: rising prefix lengths, the last one the length of the strings.
    """
    if list(ladder) != sorted(set(ladder)) or ladder[0] < 8 or ladder[-1] >= 1 << PLACE_BITS:
        raise ValueError("the prefix lengths must rise from 8 or more")
    length = ladder[-1]
    keyed = _keyed(docs)
    found = [_round(keyed.withColumn("start", F.lit(0).cast("long")), ladder[0], ladder)]
    for size in ladder[1:]:
        if len(found) == 1:
            pieces = _cut_open(_packed(keyed), found[0], length)
        else:
            pieces = found[-1].filter("open").select("id", "tie", F.shiftright("place", PLACE_BITS).alias("start"), F.col("body").alias("text"))
        found.append(_round(pieces, size, ladder))
    repeats = found[0]
    for each in found[1:]:
        repeats = repeats.unionByName(each)
    marks = _places(repeats.filter("NOT open"))

    def run(batch):
        unpack = zstandard.ZstdDecompressor().decompress
        size, spans, kept = [], [], []
        for p, places in zip(batch.column("packed").to_pylist(), batch.column("places").to_pylist(), strict=True):
            text, cut = unpack(p), covered(places, length)
            ends = [0, *(b for _, b in cut)]
            begins = [*(a for a, _ in cut), len(text)]
            size.append(len(text))
            spans.append([{"start": a, "end": b} for a, b in cut])
            kept.append(b"".join(text[a:b] for a, b in zip(ends, begins, strict=True)))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return {"doc_id": batch.column("doc_id"), "times": batch.column("times"), "n_bytes": pa.array(size, pa.int64()), "spans": pa.array(spans, kind), "kept": pa.array(kept, pa.binary())}

    span = "struct<start: bigint, `end`: bigint>"
    joined = _packed(keyed).join(marks, ["id", "tie"], "left").select("doc_id", "times", "packed", "places")
    rows = map_rows(joined, run, f"doc_id long, times long, n_bytes long, spans array<{span}>, kept binary")
    rows = rows.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times"))))
    # All rows of one doc_id and text but the first repeat it.
    again = (F.col("nth") > 1) & (F.col("n_bytes") >= length)
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end"))).cast(f"array<{span}>")
    return rows.select(
        "doc_id",
        "n_bytes",
        F.when(again, all_of_it).otherwise(F.col("spans")).alias("spans"),
        F.when(again, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
    )


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Removes from all documents what repeats an earlier string of 100 bytes."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
