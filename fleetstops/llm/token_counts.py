"""Token counts of whole texts under a unigram model, by dynamic programming shared along a trie.

Pre-tokens are the words between white space with a word mark in front. The different pre-tokens that a worker meets are
inserted in a trie, whose nodes hold the forward scores (best score and its number of tokens up to that letter). It stays from
batch to batch and task to task, so each node, a beginning that words share, is computed once. The count at a word's
terminal is stored; a text's count is the sum over its words. Memory is bounded: a full trie starts anew, and only
the first DEPTH letters of a word become nodes.

The model: pieces of a public vocabulary file. No given file holds a unigram model and tokenizers are not trained here, so
the scores are a parameter: by default the logarithm of a Zipf law over the pieces' order, or the file's own (``file_scores``).
A letter that is no piece is spelled in UTF-8 bytes, one token each, at a penalty below every piece's score.
Among equal scores the fewer tokens count.

Cases: null or empty text has no words and no tokens; words of any length are counted whole; repeated rows and null
ids all get a row; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, table

#: The vocabulary's file, a parameter; the mark in front of a word; what a letter outside the vocabulary costs more.
PIECES = public_tokenizers.path("piece_bpe_32k.model")
MARK = "▁"
PENALTY = 10.0
#: Words whose counts, and trie nodes whose scores, a worker process remembers before it starts anew.
WORDS_KEPT, NODES_KEPT = 500_000, 800_000
#: Letters of a word that get nodes; the rest of a longer word is computed on a path of its own.
DEPTH = 200
#: Fixed value: the number of code points, the base in which a node and a letter make one number.
LETTERS = 0x110000


def _words(text: str | None) -> list[str]:
    """The runs between ASCII white space (empty strings among them)."""
    text = text or ""
    for space in "\t\n\v\f\r":
        text = text.replace(space, " ")
    return text.split(" ")


def _ordinary(model) -> list[int]:
    """Ids of the pieces that stand for text."""
    return [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]


def zipf_scores(path: str) -> dict[str, float]:
    """Each ordinary piece of the file with the logarithm of its share under a Zipf law over the file's order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = _ordinary(model)
    total = sum(1 / (k + 2) for k in range(len(kept)))
    return {model.id_to_piece(i): -math.log((k + 2) * total) for k, i in enumerate(kept)}


def file_scores(path: str) -> dict[str, float]:
    """Each ordinary piece with the score the file itself gives it (for files of unigram models)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return {model.id_to_piece(i): model.get_score(i) for i in _ordinary(model)}


class UnigramCounter:
    """Counts tokens of words along a trie that stays from batch to batch; see the module."""

    def __init__(self, scores: dict[str, float]):
        # Every ending of a piece, with the piece's score if it is one itself: a look back ends at the first miss.
        self._endings: dict[str, float | None] = dict.fromkeys(p[k:] for p in scores for k in range(1, len(p)))
        self._endings |= scores
        self._unknown = min(scores.values(), default=0.0) - PENALTY
        self._known: dict[str, int] = {"": 0}  # counts of the terminals
        self.nodes = 0
        self._clear()

    def _clear(self) -> None:
        """A trie of its root alone."""
        self._child: dict[int, int] = {}  # node and letter in one number
        self._best, self._tokens = [0.0], [0]  # of each node

    def counts(self, words: list[str]) -> dict[str, int]:
        """The count of each of the words."""
        return {word: self._insert(MARK + word) for word in words}

    def _insert(self, marked: str) -> int:
        """Walk down the nodes there are, compute and add the others; the count at the end."""
        if len(self._best) + min(len(marked), DEPTH) > NODES_KEPT:
            self._clear()
        child, all_best, all_tokens = self._child, self._best, self._tokens
        # Scores along the word's path, from the trie as far as it knows them.
        best, tokens, node = [0.0], [0], 0
        for letter in marked[:DEPTH]:
            below = child.get(node * LETTERS + ord(letter))
            if below is None:
                break
            node = below
            best.append(all_best[node])
            tokens.append(all_tokens[node])
        for end in range(len(best), len(marked) + 1):
            top, count = self._forward(marked, end, best, tokens)
            self.nodes += 1
            best.append(top)
            tokens.append(count)
            if end <= DEPTH:
                child[node * LETTERS + ord(marked[end - 1])] = node = len(all_best)
                all_best.append(top)
                all_tokens.append(count)
        return tokens[-1]

    def _forward(self, marked: str, end: int, best: list[float], tokens: list[int]) -> tuple[float, int]:
        """Best score of the first ``end`` letters and its number of tokens, from those of shorter beginnings."""
        endings, unknown = self._endings, self._unknown
        top, count = -math.inf, 0
        for start in range(end - 1, -1, -1):
            piece = marked[start:end]
            if piece not in endings:
                if start == end - 1:
                    top, count = best[start] + unknown, tokens[start] + len(piece.encode("utf-8", "replace"))
                break
            score = endings[piece]
            if score is None:
                if start < end - 1:
                    continue
                score, more = unknown, len(piece.encode("utf-8", "replace"))
            else:
                more = 1
            value = best[start] + score
            if value > top or value == top and tokens[start] + more < count:
                top, count = value, tokens[start] + more
        return top, count

    def texts(self, texts: list[str | None]) -> tuple[list[int], list[int]]:
        """Numbers of words and of tokens of each text."""
        split = list(map(_words, texts))
        known = self._known
        new = {w for words in split for w in words if w not in known}
        if len(known) + len(new) > WORDS_KEPT:
            known.clear()
            known[""] = 0
            new = {w for words in split for w in words if w}
        known.update(self.counts(list(new)))
        return [len(words) - words.count("") for words in split], [sum([known[w] for w in words]) for words in split]


@functools.lru_cache(2)
def counter(path: str, scores: Callable[[str], dict[str, float]]) -> UnigramCounter:
    return UnigramCounter(scores(path))


def count_tokens(docs: DataFrame, path: str = PIECES, scores: Callable[[str], dict[str, float]] = zipf_scores) -> DataFrame:
    """A row for each document: doc_id, n_words, n_tokens; ``scores`` gives the file's pieces with their scores."""

    def run(batch):
        words, tokens = counter(path, scores).texts(batch.column("text").to_pylist())
        return {"doc_id": batch.column("doc_id"), "n_words": pa.array(words, pa.int64()), "n_tokens": pa.array(tokens, pa.int64())}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_rows(rows, run, "doc_id long, n_words long, n_tokens long", rows=1024)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole text of documents."""
    return count_tokens(table(spark, sf_dir, "documents"))
