"""License scans by a trained paragraph classifier.

Paragraphs are lines, and windows of a line longer than WINDOW words (half overlapping); notices are often wrapped, so
windows over the words of a whole run of lines (up to a line without words) are looked at too. A softmax regression over
sparse word 1- to 3-grams, trained in numpy, says which license family a paragraph states, or "unknown". A paragraph is
unknown if the families' probabilities sum to less than the model's threshold, whatever template stands in it. Else
templates confirm: of a known paragraph those families where at least SIMILARITY of the word pairs of one template stand
and the probability is at least FLOOR (a paragraph may state several); a template whose pairs there are all pairs of a
fuller one (CC BY in CC BY-NC) does not count.

A notice may be spoken of instead of stated ("a phrase like ... is"). What tells them apart is the words beside the
notice, so there are n-grams across its borders too, with the notice's own words as one mark.

The model learns from the templates and variants of them (words dropped, other words around them) and, as unknown, from a
bounded sample of the table's own paragraphs that match no template, from sentences that use license words otherwise and
from sentences that speak of notices. Threshold and temperature come from FOLDS models, each trained without a share of the
templates (with all their variants), of the sentences and of the paragraphs, and without some examples of all others. The
threshold is fitted on the scores of whole templates and sentences that a model has not seen; ``Model.held`` keeps precision
and recall of known against unknown there. The temperature is fitted on unseen examples of notices it knows, which is what
a probability is mostly asked for.

Only n-grams seen in training have weights, so a paragraph without any word whose presence can raise a family over
unknown is unknown for sure, and is passed over unless a template stands in it.

Cases: null or empty text has no paragraphs and no licenses; a text of any length is scanned whole, window by window;
repeated rows are scanned alike; an empty table trains on the templates and fixed sentences alone and gives no rows.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, materialize, sample_keys, table

#: Families and what states them (names and opening words of public licenses and usual notices).
TEMPLATES = {
    "agpl": [
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc0": [
        "Released under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "proprietary": [
        "All rights reserved.",
        "No part of this publication may be reproduced without prior written permission of the publisher.",
    ],
}

#: Sentences with license words that state no license.
OTHERWISE = [
    "She renewed her driving license at the public office last week.",
    "A general license to operate the radio was refused by the court.",
    "The version of the story released under his name was modified by the editor.",
    "The work is subject to the terms of the lease and to prior permission of the owner.",
    "Apache helicopters flew over the source of the river.",
    "The institute in Massachusetts, MIT, published the results of the study.",
    "Free software is a matter of liberty, said the general in public.",
    "The library is open to any person free of charge.",
    "Conditions in the reserve are met with warranty and copyright questions.",
    "Use of this road is governed by local law and the following conditions.",
    "The creative commons room is reserved for international work.",
    "All seats at the table are reserved for the winners.",
]

#: Sentences that speak of a notice, which stands at the braces, without stating it.
MENTIONS = [
    "He said that {} is a phrase.",
    "She was {} plate scheme.",
    "The band was called {} and played on Friday.",
    "What does {} mean in this sentence?",
    "The words {} appear on many pages.",
    "They asked whether {} is a joke.",
    "A sign that reads {} hung over the door.",
    "It was not {} but another text.",
    "Nobody knows why {} was written there.",
    "We were told that {} means nothing here.",
    "The term {} is explained in the next chapter.",
    "People often say {} when they mean something else.",
    "I think that {} is a title of a song.",
    "A line like {} was read to the class.",
    "The phrase {} means little to a reader.",
]

UNKNOWN = "unknown"
#: A notice's words as one word of an n-gram across its border.
SLOT = "_"
#: Bounds and parameters: documents whose paragraphs are learned from, paragraphs, characters of one (longer ones are not
#: learned from), words of a window, variants of a template, least share of a template's word pairs, least probability of
#: a confirmed family, shares held out in turn, training steps and rate.
SAMPLE_DOCS, SAMPLE_PARAGRAPHS, SAMPLE_LENGTH, WINDOW, VARIANTS, SIMILARITY, FLOOR = 1000, 4000, 2000, 64, 12, 0.8, 0.001
FOLDS, STEPS, RATE, SHRINK = 3, 300, 0.1, 1e-3

_WORD = re.compile(r"[^\W_]+")
#: Comment marks that are words; all others are no words anyway.
_MARK = re.compile(r"\s*(?:dnl|@?rem)\s", re.IGNORECASE)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(words: list[str]) -> set[str]:
    """1- to 3-grams, space-joined."""
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def slot_grams(words: list[str], spans: list[tuple[int, int]]) -> set[str]:
    """2- and 3-grams across the borders of the notices at ``spans`` (from, to), each notice as one mark."""
    out = set()
    for a, b in spans:
        own = [*words[max(0, a - 2) : a], SLOT, *words[b : b + 2]]
        at = min(2, a)
        for n in (2, 3):
            out |= {" ".join(own[i : i + n]) for i in range(max(0, at - n + 1), min(at, len(own) - n) + 1)}
    return out


def features(words: list[str], spans: list[tuple[int, int]] | None = None) -> set[str]:
    """What the classifier sees; ``spans`` of templates that stand are looked for where not given."""
    if spans is None:
        spans = spans_of(stated(words, marks_of(words)))
    return grams(words) | slot_grams(words, spans)


def spans_of(hits: dict, start: int = 0) -> list[tuple[int, int]]:
    """(from, to) of the words of each template that ``stated`` found, counted from ``start``."""
    return sorted({(min(places) - start, max(places) + 2 - start) for _, places in hits.values()})


def similarity(family: str, words: list[str]) -> float:
    """The largest share of the word pairs of one of the family's templates that are word pairs here."""
    pairs = set(zip(words, words[1:], strict=False))
    return max((len(pairs & t) / len(t) for t in _template_pairs()[family]), default=0.0)


@functools.cache
def _template_pairs() -> dict[str, list[set]]:
    split = {f: [words_of(t) for t in ts] for f, ts in TEMPLATES.items()}
    return {f: [set(zip(w, w[1:], strict=False)) for w in ts] for f, ts in split.items()}


@functools.cache
def _pair_templates() -> dict[tuple, list[tuple[str, int]]]:
    """Word pair -> the templates (family, number) that hold it."""
    out: dict[tuple, list] = {}
    for family, templates in _template_pairs().items():
        for k, pairs in enumerate(templates):
            for pair in pairs:
                out.setdefault(pair, []).append((family, k))
    return out


def marks_of(words: list[str]) -> list[int]:
    """Places of the word pairs that some template holds."""
    known = _pair_templates()
    return [i for i, pair in enumerate(zip(words, words[1:], strict=False)) if pair in known]


def stated(words: list[str], marks: list[int]) -> dict[tuple[str, int], tuple[float, set[int]]]:
    """Templates that stand in words: share of their word pairs and the pairs' places."""
    at: dict[tuple, set[int]] = {}
    for i in marks:
        for template in _pair_templates()[words[i], words[i + 1]]:
            at.setdefault(template, set()).add(i)
    out = {}
    for (family, k), places in at.items():
        size = len(_template_pairs()[family][k])
        if len(places) < SIMILARITY * size:
            continue
        share = len({(words[i], words[i + 1]) for i in places}) / size
        if share >= SIMILARITY:
            out[family, k] = share, places
    # Not what is part of a fuller notice; of two with the same pairs the larger share counts.
    return {
        t: (share, places)
        for t, (share, places) in out.items()
        if not any(places < more or places == more and (much, o) > (share, t) for o, (much, more) in out.items())
    }


def _draw(*what) -> int:
    return zlib.crc32("|".join(map(str, what)).encode())


def examples(background: list[str]) -> list[tuple[str, list[str]]]:
    """(family, words) of all training examples, in a fixed order."""
    return [(family, words) for family, words, _ in _examples(background)]


def _examples(background: list[str]) -> list[tuple[str, list[str], tuple[int, ...]]]:
    """(family, words, folds): an example is held out in any of its folds, its template's and its sentence's."""
    plain = [w for w in map(words_of, background) if len(w) > 1]
    plain = [w for w in plain if max(similarity(f, w) for f in TEMPLATES) < SIMILARITY / 2]
    out = [(UNKNOWN, w, (_draw("plain", i) % FOLDS,)) for i, w in enumerate(plain)]
    out += [(UNKNOWN, words_of(t), (i % FOLDS,)) for i, t in enumerate(OTHERWISE)] * 4
    around = plain or [words_of(t) for t in OTHERWISE]
    number = 0
    for family, templates in TEMPLATES.items():
        for k, template in enumerate(templates):
            words, fold = words_of(template), number % FOLDS
            number += 1
            out.append((family, words, (fold,)))
            for v in range(VARIANTS):
                some = [w for i, w in enumerate(words) if _draw(family, k, v, i) % 10] or words
                other = around[_draw(family, k, v) % len(around)]
                out.append((family, other[: v % 4 * 3] + some + other[len(other) - v % 3 * 4 :], (fold,)))
            for m, mention in enumerate(MENTIONS):
                before, after = map(words_of, mention.split("{}"))
                out.append((UNKNOWN, before + words + after, (fold, m % FOLDS)))
    return out


class Model:
    """Weights of n-grams for each family, base scores, temperature, threshold of known paragraphs and held-out figures."""

    def __init__(
        self, families: list[str], weights: dict[str, list[float]], base: list[float], temperature: float = 1.0, threshold: float = 0.5, held: dict | None = None
    ):
        self.families, self.weights, self.base, self.temperature, self.threshold = families, weights, np.array(base), temperature, threshold
        self.held = held or {}
        rows = {g: np.array(w) for g, w in weights.items()}
        self._rows = rows
        # A word, the longest, of each n-gram that raises some family over unknown, the last class. N-grams across a
        # notice's border are left out: where a template stands the paragraph is scored anyway.
        own = {g: w for g, w in rows.items() if SLOT not in g.split()}
        self.signal = {max(g.split(), key=len) for g, w in own.items() if (w[:-1] > w[-1]).any()}
        self.sure = not self.known(self.probabilities([], []))

    def scores(self, words: list[str], spans: list[tuple[int, int]] | None = None) -> np.ndarray:
        """Log-odds before the temperature."""
        found = [self._rows[g] for g in sorted(features(words, spans)) if g in self._rows]
        return self.base + (np.sum(found, axis=0) / np.sqrt(len(found)) if found else 0)

    def probabilities(self, words: list[str], spans: list[tuple[int, int]] | None = None) -> np.ndarray:
        """The calibrated probability of each family, unknown last."""
        return _softmax(self.scores(words, spans) / self.temperature)

    def known(self, p: np.ndarray) -> bool:
        """Whether probabilities say that a paragraph states a license."""
        return bool(1 - p[-1] >= self.threshold)

    def predict(self, words: list[str]) -> tuple[str, float]:
        """The likeliest family and its calibrated probability."""
        p = self.probabilities(words)
        k = int(p.argmax())
        return self.families[k], float(p[k])

    def dump(self) -> str:
        return json.dumps([self.families, self.weights, self.base.tolist(), self.temperature, self.threshold, self.held])


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=-1, keepdims=True))
    return p / p.sum(axis=-1, keepdims=True)


@functools.lru_cache(2)
def loaded(dump: str) -> Model:
    return Model(*json.loads(dump))


@functools.cache
def _weighted() -> dict[str, int]:
    """The n-grams that may have weights: those of the fixed texts (what words around a notice say of it is chance) and
    those across the border of a notice that is spoken of."""
    out = set().union(*(grams(words_of(t)) for t in (*sum(TEMPLATES.values(), []), *OTHERWISE)))
    for mention in MENTIONS:
        before, after = map(words_of, mention.split("{}"))
        out |= slot_grams([*before, SLOT, *after], [(len(before), len(before) + 1)])
    return {g: i for i, g in enumerate(sorted(out))}


def train(rows: list[tuple[str, list[str]]]) -> Model:
    """Softmax regression by full-batch Adam steps with L1 shrinkage, at temperature 1."""
    return _train([(f, _places(w)) for f, w in rows])


def _places(words: list[str]) -> list[int]:
    return sorted(_weighted()[g] for g in features(words) if g in _weighted())


def _train(rows: list[tuple[str, list[int]]]) -> Model:
    """``train`` of rows whose n-grams are given by their places."""
    families, place = [*TEMPLATES, UNKNOWN], _weighted()
    times = Counter((f, tuple(s)) for f, s in rows)
    rows, often = list(times), np.array(list(times.values()), dtype=np.float64)[:, None]
    size = np.array([len(s) for _, s in rows])
    # The last place of each row is the base's.
    at = np.concatenate([np.array([*s, len(place)], dtype=np.int64) for _, s in rows])
    row = np.repeat(np.arange(len(rows)), size + 1)
    value = np.where(at == len(place), 1.0, 1 / np.sqrt(np.maximum(1, size))[row])[:, None]
    first = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    y = np.eye(len(families))[[families.index(f) for f, _ in rows]]
    # Each class weighs the same in sum, but unknown, which is most of any corpus, half of all.
    share = (y * often).sum(axis=0)
    weight = np.where(np.arange(len(families)) < len(families) - 1, 0.5 / len(TEMPLATES), 0.5) / np.maximum(1, share)
    weight = (y * weight).sum(axis=1, keepdims=True) * often
    w = np.zeros((len(place) + 1, len(families)))
    mean, spread = np.zeros_like(w), np.zeros_like(w)
    order = np.argsort(at, kind="stable")
    seen, starts = np.unique(at[order], return_index=True)
    for step in range(1, STEPS + 1):
        p = _softmax(np.add.reduceat(w[at] * value, first, axis=0))
        g = np.zeros_like(w)
        g[seen] = np.add.reduceat((((p - y) * weight)[row] * value)[order], starts, axis=0)
        mean, spread = 0.9 * mean + 0.1 * g, 0.999 * spread + 0.001 * g * g
        rate = RATE * (0.5 + 0.5 * np.cos(np.pi * step / STEPS)) + 1e-4
        scale = np.sqrt(spread / (1 - 0.999**step)) + 1e-8
        w -= rate * mean / (1 - 0.9**step) / scale
        w[:-1] = np.sign(w[:-1]) * np.maximum(0, np.abs(w[:-1]) - rate * SHRINK * 1e-2 / scale[:-1])
    return Model(families, {g: w[i].tolist() for g, i in place.items() if w[i].any()}, w[-1].tolist())


def train_checked(background: list[str]) -> Model:
    """The model of all examples, with temperature and threshold of the FOLDS models that held examples out."""
    rows = [(f, w, _places(w), folds, _draw("turn", i) % (2 * FOLDS)) for i, (f, w, folds) in enumerate(_examples(background))]
    families = [*TEMPLATES, UNKNOWN]
    # Scores and families of whole notices and sentences that are new to a model, and of single examples that are.
    wholes, singles = ([], []), ([], [])
    for k in range(FOLDS):
        part = _train([(f, s) for f, _, s, folds, turn in rows if k not in folds and turn != k])
        for f, w, _, folds, turn in rows:
            # A sentence that speaks of a notice is judged where it and the notice are new.
            to = wholes if set(folds) == {k} else singles if k not in folds and turn == k else None
            if to:
                to[0].append(part.scores(w))
                to[1].append(families.index(f))
    z, y = map(np.array, singles)

    def loss(t: float) -> float:
        p = _softmax(z / t)
        at, got = p.argmax(axis=1), p.max(axis=1)
        return float(-np.log(np.maximum(np.where(at == y, got, 1 - got), 1e-9)).sum())

    temperature = min((loss(t), t) for t in map(float, np.geomspace(0.25, 4, 17)))[1]
    z, y = map(np.array, wholes)
    p, is_known = 1 - _softmax(z / temperature)[:, -1], y < len(families) - 1
    stated_right = lambda t: int(((p >= t) & is_known).sum())
    # The least threshold with the best harmonic mean of precision and recall.
    _, threshold = max((2 * stated_right(t) / max(1, int((p >= t).sum() + is_known.sum())), -t) for t in map(float, np.geomspace(0.005, 0.95, 91)))
    got = p >= -threshold
    figures = {
        "examples": len(y),
        "precision": float((got & is_known).sum() / max(1, got.sum())),
        "recall": float((got & is_known).sum() / max(1, is_known.sum())),
        "unknown_recall": float((~got & ~is_known).sum() / max(1, (~is_known).sum())),
    }
    whole = _train([(f, s) for f, _, s, _, _ in rows])
    return Model(whole.families, whole.weights, whole.base.tolist(), temperature, -threshold, figures)


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, paragraphs: int = SAMPLE_PARAGRAPHS) -> Model:
    """Train with the paragraphs of at most ``sample_docs`` different texts, the least by hash; the table is read twice."""
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    hashes = materialize(texts.select("h").distinct(), "license_hashes")
    # The sample's hashes: a proven bound for the broadcast.
    own = texts.join(F.broadcast(sample_keys(hashes, sample_docs)), "h")
    # A long line's words in windows, as scanned.
    words = own.select(F.explode(F.split("text", "\n")).alias("line")).select(F.split("line", "[^\\p{L}\\p{N}]+").alias("words"))
    cuts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words")), F.lit(WINDOW))
    lines = words.select("words", F.explode(cuts).alias("at")).select(F.array_join(F.slice("words", F.col("at"), WINDOW), " ").alias("line"))
    lines = materialize(lines.filter(F.length("line").between(10, SAMPLE_LENGTH)).distinct(), "license_lines")
    return train_checked(sorted(r["line"] for r in sample_keys(lines, paragraphs).collect()))


def windows(n: int):
    """(from, to) of the windows over n words."""
    return [(0, n)] if n <= WINDOW else [(k, min(n, k + WINDOW)) for k in range(0, n - WINDOW // 2, WINDOW // 2)]


def runs_of(text: str):
    """Runs of lines with words: (start, words) of each line, start is the line's place in the text."""
    at, run = 0, []
    for line in text.split("\n"):
        words = words_of(line[m.end() :] if (m := _MARK.match(line)) else line)
        if words:
            run.append((at, words))
        elif run:
            yield run
            run = []
        at += len(line) + 1
    if run:
        yield run


def _scan_words(model: Model, start: int, words: list[str], at: int, hits: dict) -> list[dict]:
    """What one paragraph, in which the templates ``hits`` stand (places counted from -``at``), states: the likeliest
    family and all confirmed ones; nothing where it is unknown."""
    if not hits and model.sure and model.signal.isdisjoint(words):
        return []
    p = model.probabilities(words, spans_of(hits, at))
    if not model.known(p):
        return []
    near: dict[str, float] = {}
    for (family, _), (share, _) in hits.items():
        near[family] = max(share, near.get(family, 0.0))
    best = model.families[int(p[:-1].argmax())]
    of, known = {f: float(p[model.families.index(f)]) for f in (best, *near)}, float(1 - p[-1])
    out = [_found(start, f, of[f], known, near[f], True) for f in near if of[f] >= FLOOR]
    if best not in near:
        out.append(_found(start, best, of[best], known, similarity(best, words), False))
    return out


def _found(start: int, family: str, probability: float, known: float, share: float, confirmed: bool) -> dict:
    return {"start": start, "family": family, "probability": probability, "known": known, "similarity": share, "confirmed": confirmed}


def _hits(words: list[str], marks: list[int], a: int, b: int) -> dict:
    """``stated`` of words[a:b], with places in words; marks are of words."""
    own = marks[bisect_left(marks, a) : bisect_left(marks, b - 1)] if len(marks) > 1 else marks[:0]
    if len(own) < 2:
        return {}
    return {t: (share, {i + a for i in places}) for t, (share, places) in stated(words[a:b], [i - a for i in own]).items()}


def scan_text(model: Model, text: str | None) -> tuple[int, list[dict]]:
    """Number of paragraphs and what states a license: start, family, its probability, the probability of any (known),
    similarity, confirmed."""
    n, found, text = 0, [], text or ""
    for run in runs_of(text):
        words = [w for _, own in run for w in own]
        marks, at, seen = marks_of(words), 0, set()
        # Places of the confirmed families' templates: a notice that a line or a window before states counts once.
        had: dict[str, set[int]] = {}
        for start, own in run:
            for a, b in windows(len(own)):
                n += 1
                hits = _hits(words, marks, at + a, at + b)
                for f in _scan_words(model, start, own[a:b], at + a, hits):
                    if (start, f["family"]) not in seen:
                        found.append(f)
                    if f["confirmed"]:
                        seen.add((start, f["family"]))
                        had.setdefault(f["family"], set()).update(*(places for (family, _), (_, places) in hits.items() if family == f["family"]))
            at += len(own)
        if len(run) == 1 or len(marks) < 2:
            continue
        line = [start for start, own in run for _ in own]
        for a, b in windows(len(words)):
            hits = _hits(words, marks, a, b)
            p = model.probabilities(words[a:b], spans_of(hits, a)) if hits else None
            if p is None or not model.known(p):
                continue
            for (family, _), (share, places) in hits.items():
                own_p = float(p[model.families.index(family)])
                if own_p < FLOOR:
                    continue
                before = had.setdefault(family, set())
                if before.isdisjoint(places):
                    found.append(_found(line[min(places)], family, own_p, float(1 - p[-1]), share, True))
                before |= places
    return n, found


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """A row for each document: doc_id, n_paragraphs, found (array of what scan_text finds)."""
    dump = model.dump()

    def run(batch):
        own = loaded(dump)
        got = [scan_text(own, t) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "n_paragraphs": pa.array([n for n, _ in got], pa.int64()), "found": [f for _, f in got]}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kind = "doc_id long, n_paragraphs long, found array<struct<start:long,family:string,probability:double,known:double,similarity:double,confirmed:boolean>>"
    return map_rows(rows, run, kind)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans every whole text of documents; families confirmed in each, the highest probability that a confirming
    paragraph states a license (null: none does), and how much was confirmed and predicted."""
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, fit(docs))
    sure = F.filter("found", lambda x: x["confirmed"])
    return found.select(
        "doc_id",
        "n_paragraphs",
        F.array_join(F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))), ",").alias("families"),
        F.array_max(F.transform(sure, lambda x: x["known"])).alias("probability"),
        F.size(sure).cast("long").alias("n_confirmed"),
        F.size("found").cast("long").alias("n_predicted"),
    )
