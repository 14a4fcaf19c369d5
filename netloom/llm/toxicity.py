"""Toxicity scores from a lexicon matched with misspellings, in context.

The lexicon is learnt: terms that toxic training documents use in many
different contexts and other documents hardly. Its trie is intersected with the
Levenshtein automata of the terms into one deterministic automaton, which reads
the words of a batch side by side, a letter at a time; most words leave it
within a few letters. Each hit is weighed by its context: within quotation
marks or after a reporting word it counts as quotation, otherwise as abuse. A
logistic model over the weighed hits gives the score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.language_id import held_out
from netloom.llm.lineage import cut
from netloom.llm.text import WORD, chunks, code_points, prefix_hash, shingle_hashes, span_hash, spans, utf8

#: Labelled training documents used at most, those of the smallest hashes.
TRAINING_ROWS = 20_000
#: Log-odds of a term at least, at the lower end of its interval of so many standard errors.
LEAST_ODDS, ERRORS = 1.5, 1.96
#: Letters of a term at most.
LONGEST = 64
#: Terms in one automaton; a larger lexicon has several, which are all run.
PART = 32
#: Code points on either side of a hit that make its context.
WINDOW = 80
#: What a quoted hit counts for.
QUOTED = 0.25
#: Weight of a misspelt hit at least, as a share of an exact hit's.
MISSPELT = 0.8

# fixed values: words that announce quoted speech or talk about a word
REPORTING = re.compile(r"\b(?:said|says|wrote|writes|called|calls|quote|quoted|quoting|word|words|term|termed|phrase|slur|insult|sagte|schrieb|nannte|wort|zitat|dit|écrit|mot|citation|terme|dijo|escribió|palabra|cita|término)\b[^.!?\n]{0,24}$", re.IGNORECASE)
QUOTES = "\"“”«»„‟"


_INNER = np.zeros(1 << 16, bool)
_INNER[[ord(c) for c in "*@$!"]] = True


def words(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code points, and starts and ends of words: runs of letters and
    digits, with ``*@$!`` between two of them."""
    plain = np.minimum(points, np.uint32(0xFFFF))
    low = WORD[plain]
    inside = low != 0
    middle = np.zeros(len(points), bool)
    middle[1:-1] = inside[:-2] & inside[2:] & _INNER[plain[1:-1]]
    some = offsets[:-1] < offsets[1:]
    middle[offsets[:-1][some]] = middle[offsets[1:][some] - 1] = False
    return np.where(middle, plain, low), *spans(inside | middle, offsets)


def _text(low: np.ndarray, start: int, end: int) -> str:
    return low[start:end].tobytes().decode("utf-32-le", "replace")


def edits(term: str) -> int:
    """The misspellings allowed: none below 5 letters, 1 from there, 2 from 12."""
    return 0 if len(term) < 5 else 1 if len(term) < 12 else 2


class Automaton:
    """The deterministic intersection of the terms' Levenshtein automata with their trie.

    A state is the set of (trie node, edits so far) that the letters read can
    have reached, without those that another one at the same node beats.
    Letters outside the terms share one symbol.
    """

    def __init__(self, terms: list[str]) -> None:
        self.terms = terms
        children: list[dict[str, int]] = [{}]
        ends, most = [-1], [0]
        for k, term in enumerate(terms):
            node = 0
            most[0] = max(most[0], edits(term))
            for c in term:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    ends.append(-1)
                    most.append(0)
                node = children[node][c]
                most[node] = max(most[node], edits(term))
            ends[node] = k
        letters = sorted({c for t in terms for c in t})
        self.symbols = np.zeros(1 << 16, np.int32)
        for k, c in enumerate(letters):
            self.symbols[ord(c)] = k + 1

        def closed(reached: dict[int, int]) -> tuple[tuple[int, int], ...]:
            # a letter of the term that is missing: one edit, no input
            for e in range(max(most) + 1):
                for node in [n for n, x in reached.items() if x == e]:
                    for to in children[node].values():
                        if e + 1 <= most[to] and reached.get(to, 99) > e + 1:
                            reached[to] = e + 1
            return tuple(sorted(reached.items()))

        states = {closed({0: 0}): 0}
        table: list[list[int]] = []
        queue = list(states)
        for state in queue:  # grows while it is read
            row = []
            for c in ["", *letters]:
                reached: dict[int, int] = {}
                for node, e in state:
                    steps = [(node, e + 1), *((to, e + (c != x)) for x, to in children[node].items())]
                    for to, cost in steps:
                        if cost <= most[to] and reached.get(to, 99) > cost:
                            reached[to] = cost
                key = closed(reached)
                if not key:
                    row.append(-1)
                    continue
                if key not in states:
                    states[key] = len(states)
                    queue.append(key)
                row.append(states[key])
            table.append(row)
        self.steps = np.array(table, np.int32).reshape(len(states), len(letters) + 1)
        self.term, self.distance = np.full(len(states), -1, np.int32), np.full(len(states), 99, np.int32)
        for state, k in states.items():
            for node, e in state:
                if ends[node] >= 0 and e <= edits(terms[ends[node]]) and e < self.distance[k]:
                    self.term[k], self.distance[k] = ends[node], e

    def match(self, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, term, distance) of the words low[start:end] that the automaton accepts."""
        word, state, at = np.arange(len(start)), np.zeros(len(start), np.int32), start
        found = []
        while len(word):
            done = at == end[word]
            if done.any():
                hit = done & (self.term[state] >= 0)
                found.append((word[hit], self.term[state[hit]], self.distance[state[hit]]))
                word, state, at = word[~done], state[~done], at[~done]
            state = self.steps[state, self.symbols[low[at]]]
            alive = state >= 0
            word, state, at = word[alive], state[alive], at[alive] + 1
        parts = [np.concatenate(x) if found else np.zeros(0, np.int64) for x in (zip(*found, strict=True) if found else [[], [], []])]
        order = np.argsort(parts[0], kind="stable")
        return tuple(x[order] for x in parts)


class Lexicon:
    """The automata of all terms."""

    def __init__(self, terms: list[str]) -> None:
        self.parts = [Automaton(terms[i : i + PART]) for i in range(0, len(terms), PART)]

    def match(self, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, distance) of the words low[start:end] near a term, each once at its least distance."""
        least = np.full(len(start), 99)
        for part in self.parts:
            word, _, distance = part.match(low, start, end)
            least[word] = np.minimum(least[word], distance)
        word = np.flatnonzero(least < 99)
        return word, least[word]


@dataclass
class Scorer:
    lexicon: Lexicon
    weights: np.ndarray
    #: Words near a term that ordinary documents use, so no misspellings of it.
    ordinary: frozenset[str] = frozenset()

    def features(self, column: pa.Array) -> Iterator[tuple[np.ndarray, int, int]]:
        """For each text: (1, exact hits, misspelt hits, their share of the words), and its hits and quoted hits."""
        data, offsets = utf8(column)
        for lo, hi in chunks(offsets):
            points, bounds = code_points(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            low, start, end = words(points, bounds)
            word, distance = self.lexicon.match(low, start, end)
            meant = np.array([d == 0 or _text(low, start[w], end[w]) not in self.ordinary for w, d in zip(word, distance, strict=True)], bool)
            word, distance = word[meant], distance[meant]
            row = np.searchsorted(bounds, start[word], side="right") - 1
            quoted = [self.is_quoted(points, int(start[w]), int(end[w]), int(bounds[r]), int(bounds[r + 1])) for w, r in zip(word, row, strict=True)]
            counts = np.where(quoted, QUOTED, 1.0)
            n = hi - lo
            exact, fuzzy = (np.bincount(row, counts * x, minlength=n) for x in (distance == 0, distance > 0))
            size = np.diff(np.searchsorted(start, bounds))
            hits, inside = np.bincount(row, minlength=n), np.bincount(row, quoted, minlength=n).astype(int)
            share = np.log1p(100 * exact / np.maximum(size, 1))
            yield from zip(np.stack([np.ones(n), np.log1p(exact), np.log1p(fuzzy), share], 1), hits.tolist(), inside.tolist(), strict=True)

    @staticmethod
    def is_quoted(points: np.ndarray, start: int, end: int, lo: int, hi: int) -> bool:
        """Whether the context window of a hit shows quotation: an odd number of
        quotation marks before it and one after, or a reporting word before it
        in its sentence."""
        before = points[max(lo, start - WINDOW) : start].tobytes().decode("utf-32-le", "replace")
        after = points[end : min(hi, end + WINDOW)].tobytes().decode("utf-32-le", "replace")
        marks = sum(c in QUOTES for c in before)
        return (marks % 2 == 1 and any(c in QUOTES for c in after)) or bool(REPORTING.search(before))

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weights, -30, 30)))


def _uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text the distinct words of up to LONGEST letters, with a signature
    of the text: the least hash of its runs of three words, which copies and most near copies share."""
    for batch in batches:
        data, offsets = utf8(batch.column(0))
        for lo, hi in chunks(offsets):
            points, bounds = code_points(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            low, start, end = words(points, bounds)
            bounds = np.searchsorted(start, bounds)
            hashes = span_hash(prefix_hash(low), start, end)
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if a == b:
                    continue
                _, at = np.unique(hashes[a:b], return_index=True)
                at = at[end[a + at] - start[a + at] <= LONGEST] + a
                sign = shingle_hashes(hashes[a:b], 3).min().view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([_text(low, start[i], end[i]) for i in at], pa.string()), pa.array(np.full(len(at), sign))], ["word", "sign"])


def lexicon(sample: DataFrame) -> list[str]:
    """Terms of ``sample(text, toxic)`` that mark toxic documents, in order.

    A word counts once per different signature of the texts that have it, so
    neither copies nor lists make it look frequent. Every word is kept whose
    log-odds against other documents are LEAST_ODDS at least, at the lower end
    of their confidence interval.
    """
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic:
        return []
    count = lambda k: sample.where(F.col("toxic") == k).select("text").mapInArrow(_uses, "word string, sign long").distinct().groupBy("word").agg(F.count("*").alias("n"))
    seen, usual = count(1).withColumnRenamed("n", "x").where("x > 1"), count(0).withColumnRenamed("n", "y")
    x, y = F.col("x") + 0.5, F.coalesce("y", F.lit(0)) + 0.5
    odds = F.log(x / (toxic + 1)) - F.log(y / (clean + 1)) - ERRORS * F.sqrt(1 / x + 1 / y)
    return sorted(r["word"] for r in seen.join(usual, "word", "left").where(odds >= LEAST_ODDS).select("word").collect())


def train(docs: DataFrame, labels: DataFrame) -> Scorer:
    """A scorer learnt from ``labels(doc_id, toxic)`` of at most TRAINING_ROWS
    documents that aren't held out. A document with several labels counts as
    toxic if one says so; null labels and labels without a document aren't used."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAINING_ROWS)
    sample = cut(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "toxic"))
    terms = Lexicon(lexicon(sample))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for lo, hi in chunks(offsets):
                low, start, end = words(*code_points(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))
                word, distance = terms.match(low, start, end)
                yield pa.RecordBatch.from_arrays([pa.array(sorted({_text(low, start[w], end[w]) for w in word[distance > 0]}), pa.string())], ["word"])

    ordinary = sample.where("toxic = 0").select("text").mapInArrow(near, "word string").distinct().toArrow()["word"].to_pylist()
    scorer = Scorer(terms, np.zeros(4), frozenset(ordinary))
    send = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([x for x, _, _ in send.value.features(batch.column(0))]).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([*map(pa.array, x.T), batch.column(1)], ["a", "b", "c", "d", "toxic"])

    table = sample.mapInArrow(run, "a double, b double, c double, d double, toxic int").toPandas()
    x, y = table[["a", "b", "c", "d"]].to_numpy(float), table["toxic"].to_numpy(float)
    scorer.weights = _fit(x, y)
    scorer.weights[2] = max(scorer.weights[2], MISSPELT * scorer.weights[1])
    return scorer


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method; without rows of both kinds, the prior: hits are toxic."""
    weights = np.array([-2.0, 2.0, 1.0, 0.5])
    if len(y) == 0 or y.min() == y.max():
        return weights
    penalty = ridge * np.eye(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - ridge * weights)
        weights = weights + step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """(doc_id, score, predicted, hits, quoted_hits) of ``docs(doc_id, text)``.

    Texts are read whole. A null or empty text has no hits and the score of
    such. Repeated rows give a row each; other columns are ignored.
    """
    send = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(send.value.features(batch.column(1)))
            value = send.value.score(np.array([x for x, _, _ in rows]).reshape(-1, 4))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value), pa.array((value >= 0.5).astype(np.int32)), pa.array([n for _, n, _ in rows], pa.int32()), pa.array([n for _, _, n in rows], pa.int32())], ["doc_id", "score", "predicted", "hits", "quoted_hits"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int, hits int, quoted_hits int")
