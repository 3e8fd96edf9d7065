"""Toxicity by non-negative positive-unlabelled learning.

A logistic model over sparse word features is trained in numpy from confirmed toxic documents and from unlabelled
text; no text is learned from as "not toxic". The class prior p is a parameter: by default the share of positives
among all labelled documents (the one use of other labels), or an estimate from the two samples (``class_prior``).
With p, the risk of calling unlabelled text toxic is corrected by the positives it must hold: R = p R+(positives) + max(0, R-(unlabelled) - p R-(positives)). While the
second part is negative, which only chance or over-fitting can make it, it pulls at nothing.

Features of a text: its lower-cased words and their beginnings of 4 to 7 letters, each at the levels "at least 1, 2
and 4 times", hashed. L1 shrinkage leaves some hundreds of them with a weight, so the model is small.

Training reads a bounded sample (POSITIVES and UNLABELLED documents, chosen by hash of doc_id over the whole table);
scoring reads every whole text in tasks, with a table of words of bounded size in each worker.

Cases: null text counts as empty, an empty text gets the model's base score; no confirmed toxic document (or an empty
table) trains nothing and every score is the prior's, 0; rows with a null doc_id are scored and never learned from;
of contradicting labels of one document the positive counts; repeated rows are scored alike.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import fresh, map_rows, materialize, q, table

#: Bounds of the training sample, in documents.
POSITIVES, UNLABELLED = 1500, 4000
#: A document is predicted toxic from this score on.
CUT = 0.3
#: Features: letters of word beginnings, levels of their counts, number of hash values, least positives with one.
PREFIXES, LEVELS, SPACE, LEAST = (4, 5, 6, 7), (1, 2, 4), 1 << 22, 5
#: Training: steps, first learning rate, L1 shrinkage (divided by the root of the number of positives).
STEPS, RATE, SHRINK = 150, 0.1, 0.03
#: The loss of calling a text clean stops growing at this score (log-odds): an unlabelled sample's share of positives
#: differs from the prior by chance, and an unbounded loss would multiply that difference.
MARGIN = 4.0
#: Class prior: folds; the prior that the models which rank them take; how often the allowance for chance may fail.
FOLDS, START, DOUBT = 5, 0.2, 0.1
#: Number of places by hash that documents are drawn from.
PLACES = 1 << 62
#: Words whose features a worker remembers before it starts anew.
WORDS_KEPT = 400_000

_WORD = re.compile(r"[^\W_]+")


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learned from: crc32 of doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _bases(word: str) -> list[int]:
    """Hashes of a word and of its beginnings; those start from another value, so a word and a beginning differ."""
    whole, letters = word.encode("utf-8", "replace"), len(word)
    found = [zlib.crc32(whole) % SPACE]
    plain = len(whole) == letters
    for k in PREFIXES:
        if k >= letters:
            break
        found.append(zlib.crc32(whole[:k] if plain else word[:k].encode("utf-8", "replace"), 1) % SPACE)
    return found


def _hashed(base: int, level: int) -> int:
    """The feature of a base at a level: an exchange of bits, so a feature leads back to its base."""
    return base ^ (level * 0x9E3779B1) % SPACE


def features(text: str | None) -> np.ndarray:
    """Hashes of all features of a text, sorted."""
    counts: Counter = Counter()
    for word, times in Counter(_WORD.findall((text or "").lower())).items():
        for base in _bases(word):
            counts[base] += times
    found = {_hashed(base, level) for base, times in counts.items() for level in LEVELS if times >= level}
    return np.array(sorted(found), dtype=np.int32)


@dataclass(frozen=True)
class Model:
    """A logistic model: base score and the weights of hashed features."""

    base: float
    weights: dict[int, float]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def frequent(positives: list[np.ndarray]) -> np.ndarray:
    """Features that at least LEAST positives have; no other gets a weight."""
    seen = np.zeros(SPACE, dtype=np.int32)
    for row in positives:
        seen[row] += 1
    return np.flatnonzero(seen >= min(LEAST, len(positives)))


def train(positives: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Model:
    """Fit by full-batch Adam steps with shrinkage on the non-negative risk; nothing random."""
    if not positives or not unlabelled or not 0 < prior < 1:
        return Model(-30.0, {})
    kept = frequent(positives)
    place = np.full(SPACE, -1, dtype=np.int32)
    place[kept] = np.arange(len(kept))

    def sparse(rows):
        own = [at[at >= 0] for at in (place[x] for x in rows)]
        return np.concatenate(own), np.repeat(np.arange(len(own), dtype=np.int32), [len(x) for x in own]), len(own)

    (ip, rp, n_p), (iu, ru, n_u) = sparse(positives), sparse(unlabelled)
    size, shrink = len(kept), SHRINK / np.sqrt(n_p)
    w = np.zeros(size + 1)
    w[-1] = np.log(prior / (1 - prior))
    mean, spread = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, STEPS + 1):
        zp = np.bincount(rp, w[ip], n_p) + w[-1]
        zu = np.bincount(ru, w[iu], n_u) + w[-1]
        up = -prior * _sigmoid(-zp) / n_p
        excess = np.mean(_loss(zu)) - prior * np.mean(_loss(zp))
        if excess >= 0:
            gp, gu = up - prior * _slope(zp) / n_p, _slope(zu) / n_u
        else:
            gp, gu = up, np.zeros(n_u)
        g = np.append(np.bincount(ip, gp[rp], size) + np.bincount(iu, gu[ru], size), gp.sum() + gu.sum())
        mean, spread = 0.9 * mean + 0.1 * g, 0.999 * spread + 0.001 * g * g
        rate = RATE * (0.5 + 0.5 * np.cos(np.pi * step / STEPS)) + 1e-4
        scale = np.sqrt(spread / (1 - 0.999**step)) + 1e-8
        w -= rate * mean / (1 - 0.9**step) / scale
        w[:-1] = np.sign(w[:-1]) * np.maximum(0, np.abs(w[:-1]) - rate * shrink / scale[:-1])
    used = np.flatnonzero(w[:-1])
    return Model(float(w[-1]), dict(zip(kept[used].tolist(), w[used].tolist(), strict=True)))


def _loss(z):
    return np.logaddexp(0, np.minimum(z, MARGIN))


def _slope(z):
    return np.where(z < MARGIN, _sigmoid(z), 0.0)


def class_prior(positives: list[np.ndarray], unlabelled: list[np.ndarray]) -> float:
    """The share of positives in unlabelled text, from those two alone (the best-bin estimate of a mixture's share).

    Each fold is ranked by a model that the other folds taught. Above a score that few clean documents reach, the
    unlabelled ones are the prior's share of the positives there: so the prior is the ratio of both shares above the
    score at which that ratio, with an allowance for chance, is least.
    """
    if not positives or not unlabelled:
        return 0.0
    totals: tuple[list[float], list[float]] = ([], [])
    for k in range(FOLDS):
        model = train(*([x for i, x in enumerate(rows) if i % FOLDS != k] for rows in (positives, unlabelled)), START)
        scorer = Scorer(model.base, tuple(model.weights.items()))
        for rows, found in zip((positives, unlabelled), totals, strict=True):
            found += [scorer.total(x) for x in rows[k::FOLDS]]
    p, u = map(np.sort, totals)
    at = np.unique(p)
    above_p, above_u = 1 - np.searchsorted(p, at) / len(p), 1 - np.searchsorted(u, at) / len(u)
    chance = np.sqrt(np.log(4 / DOUBT) / 2) * (1 / np.sqrt(len(u)) + 1 / np.sqrt(len(p)))
    best = np.argmin((above_u + chance) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 1 / (1 + len(u)), 0.99))


def fit(docs: DataFrame, labels: DataFrame, prior: float | Callable | None = None, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Train on documents whose doc_id isn't held out.

    ``prior``: share of toxic documents in unlabelled text; a function of both samples' features that estimates it
    (:func:`class_prior`); None: the share of positives among the labelled documents.
    """
    if prior is None:
        known = labels.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        prior = known.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0] or 0.0
    drawn = _drawn(docs, labels, positives, unlabelled)
    of_positives = drawn.filter("positive")
    least = min(LEAST, of_positives.count())
    kept = of_positives.select(F.explode("f").alias("f")).groupBy("f").count().filter(F.col("count") >= least).select("f").toArrow()
    # Only features that can get a weight come to the driver.
    wanted = np.zeros(SPACE, dtype=bool)
    wanted[kept.column("f").to_numpy()] = True

    def run(batch):
        rows = (x.values.to_numpy() for x in batch.column("f"))
        return {**{c: batch.column(c) for c in ("doc_id", "positive", "open")}, "f": [x[wanted[x]] for x in rows]}

    got = map_rows(drawn, run, "doc_id long, positive boolean, open boolean, f array<int>").toArrow().sort_by([("doc_id", "ascending")])
    rows = [np.array(x.values, dtype=np.int32) for x in got.column("f")]
    toxic, other = ([x for x, yes in zip(rows, got.column(c).to_pylist(), strict=True) if yes] for c in ("positive", "open"))
    return train(toxic, other, prior(toxic, other) if callable(prior) else prior)


def _drawn(docs: DataFrame, labels: DataFrame, positives: int, unlabelled: int) -> DataFrame:
    """The bounded sample, written: doc_id, positive, open (drawn as an unlabelled one), f (its features).

    The table's ids are read once and written, with their places by hash; then the texts of the drawn ones are read.
    """
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    learned = F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    toxic = labels.filter(F.col("toxic") == 1).select(doc_id).filter(learned).distinct().withColumn("toxic", F.lit(True))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(PLACES)).alias("place")
    ids = docs.select(doc_id).filter(learned).distinct().join(toxic, "doc_id", "left")
    ids = materialize(ids.select("doc_id", F.coalesce("toxic", F.lit(False)).alias("toxic"), place), "toxicity-ids")
    n, n_toxic = ids.agg(F.count(F.lit(1)), F.count_if("toxic")).first()

    def least(rows: DataFrame, of: int, most: int) -> DataFrame:
        # About twice the wanted rows reach the one task that ranks them.
        below = PLACES if of <= 2 * most else PLACES // of * 2 * most
        return rows.filter(F.col("place") < F.lit(below)).orderBy("place", "doc_id").limit(most)

    chosen = least(ids.filter("toxic"), n_toxic, positives).select("doc_id", F.lit(True).alias("positive"), F.lit(False).alias("open"))
    chosen = chosen.unionAll(least(ids, n, unlabelled).select("doc_id", F.lit(False), F.lit(True)))
    chosen = chosen.groupBy("doc_id").agg(F.max("positive").alias("positive"), F.max("open").alias("open"))

    def run(batch):
        return {**{c: batch.column(c) for c in ("doc_id", "positive", "open")}, "f": list(map(features, batch.column("text").to_pylist()))}

    texts = docs.select(doc_id, F.col("text").cast("string").alias("text"))
    # The sample's ids: a proven bound for the broadcast.
    found = map_rows(texts.join(F.broadcast(chosen), "doc_id"), run, "doc_id long, positive boolean, open boolean, f array<int>")
    # Of repeated rows one.
    one = found.groupBy("doc_id").agg(F.max("positive").alias("positive"), F.max("open").alias("open"), F.min("f").alias("f"))
    return materialize(one, "toxicity-sample")


class Scorer:
    """Scores texts; per word it keeps the bases of those parts that have a weight at some level."""

    def __init__(self, base: float, weights: tuple):
        self._start, self._weights = base, dict(weights)
        self._parts: dict[str, tuple[int, ...]] = {}
        # The bases that have a weight at some level, each with those levels.
        self._levels: dict[int, list[tuple[int, int]]] = {}
        for feature in self._weights:
            for level in LEVELS:
                self._levels.setdefault(_hashed(feature, level), []).append((level, feature))

    def _of(self, word: str) -> tuple[int, ...]:
        if len(self._parts) > WORDS_KEPT:
            self._parts.clear()
        levels = self._levels
        self._parts[word] = kept = tuple([b for b in _bases(word) if b in levels])
        return kept

    def score(self, text: str | None) -> float:
        counts: Counter = Counter()
        known = self._parts
        for word in _WORD.findall((text or "").lower()):
            bases = known.get(word)
            if bases is None:
                bases = self._of(word)
            for base in bases:
                counts[base] += 1
        found = {feature for base, n in counts.items() for level, feature in self._levels[base] if n >= level}
        return float(_sigmoid(self._start + sum(map(self._weights.__getitem__, sorted(found)))))

    def total(self, found: np.ndarray) -> float:
        """The log-odds of a text with these features."""
        return self._start + sum(self._weights.get(f, 0.0) for f in found.tolist())


@functools.lru_cache(2)
def _scorer(base: float, weights: tuple) -> Scorer:
    return Scorer(base, weights)


def with_score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``: how likely its text is toxic, 0 to 1."""
    base, weights = model.base, tuple(sorted(model.weights.items()))
    at = docs.columns.index("text")
    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])

    def run(batch):
        own = _scorer(base, weights)
        scores = pa.array([own.score(t) for t in batch.column(at).to_pylist()], pa.float64())
        return pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, name])

    return map_rows(docs, run, schema)


def clean(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with their own columns."""
    scored = with_score(docs, fit(docs, labels), name := fresh(docs, "score"))
    return scored.filter(q(name) < cut).select(*map(q, docs.columns))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every whole text of documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
