"""Toxicity: a learned lexicon, found also where misspelled, with quotation told from abuse by context.

The lexicon comes from a bounded sample of labelled documents: words, and stems of ``STEMS`` letters, that toxic documents
hold far more often than others. Its words form a trie; the Levenshtein automata of all of them, intersected with
the trie, run as one machine over each distinct word (states are sets of trie nodes with edits so far, made when
first met). A window around each hit tells use from mention: quotation marks around it or words of reporting
near it weaken the hit. A logistic model turns the hits of a document into a score.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import Lately
from .common import docs_of, fold, forget, releasing, small_batches, stored

#: Marks of quotation, and words of reporting in the languages of the tests.
OPENING, CLOSING = "\"“„«‘'‹", "\"”“»’'›"
REPORTING = frozenset("said says say wrote writes called quote quoted quotes word words term insult slur heißt sagte nannte wort zitat dit disait mot écrit dijo dice palabra escribió".split())
STEMS = (5, 6, 7)
WINDOW = 6
MENTION = 0.25
WORD = re.compile(r"\w+")
EDGE = re.compile(r"^\W+|\W+$")


def edits_for(term: str) -> int:
    return 0 if len(term) < 4 else 1 if len(term) < 8 else 2


class Machine:
    """The intersection of a trie with the Levenshtein automata of its words."""

    def __init__(self, terms: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        self.reach: list[int] = [0]
        self.terms = terms
        for i, term in enumerate(terms):
            node = 0
            self.reach[0] = max(self.reach[0], edits_for(term))
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                    self.reach.append(0)
                node = self.children[node][c]
                self.reach[node] = max(self.reach[node], edits_for(term))
            self.ends[node] = i
        #: bounds of what is kept: moves, and bytes of states
        self.most_moves, self.most_bytes = 400_000, 64 << 20
        self.clear()

    def clear(self) -> None:
        self.states: list[bytes] = []  # nodes times 4 plus edits, as 32-bit numbers in order
        self.number: dict[bytes, int] = {}
        self.accepts: list[tuple[int, int] | None] = []
        self.moves: dict[int, int] = {}  # from a state's number and a letter's
        self.held = 0
        self.start = self.state({0: 0})

    def state(self, best: dict[int, int]) -> int:
        """The state for these nodes and edits, with all that dropping letters of the terms leads to."""
        children, reach = self.children, self.reach
        todo = list(best.items())
        while todo:
            node, e = todo.pop()
            if e < reach[node] and best[node] == e:
                for child in children[node].values():
                    if e < reach[child] and e + 1 < best.get(child, 99):
                        best[child] = e + 1
                        todo.append((child, e + 1))
        if not best:
            return -1
        key = array("I", sorted([node << 2 | e for node, e in best.items()])).tobytes()
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.held += len(key) + 200
            ends = [(e, self.ends[n]) for n, e in best.items() if self.ends[n] >= 0 and e <= edits_for(self.terms[self.ends[n]])]
            self.accepts.append(min(ends) if ends else None)
        return self.number[key]

    def move(self, state: int, c: str) -> int:
        best: dict[int, int] = {}
        children, reach = self.children, self.reach
        for x in memoryview(self.states[state]).cast("I"):
            node, e = x >> 2, x & 3
            same = children[node].get(c)
            if same is not None and e <= reach[same] and e < best.get(same, 99):
                best[same] = e
            if e < reach[node]:  # one more edit: the letter is another than the term's, or one too many
                for child in children[node].values():
                    if e < reach[child] and e + 1 < best.get(child, 99):
                        best[child] = e + 1
                if e + 1 < best.get(node, 99):
                    best[node] = e + 1
        return self.state(best)

    def nearest(self, word: str) -> tuple[int, int] | None:
        """(edits, index of term) of the nearest term within its allowance, ties by index."""
        if len(self.moves) > self.most_moves or self.held > self.most_bytes:
            self.clear()
        state = self.start
        for c in word:
            step = state << 21 | ord(c)
            after = self.moves.get(step)
            if after is None:
                after = self.moves[step] = self.move(state, c)
            if after < 0:
                return None
            state = after
        return self.accepts[state]


@dataclass
class Model:
    weights: dict[str, float]  # of words, and of stems written with a star
    harmless: frozenset[str] = frozenset()  # words near a term that documents without label 1 hold
    coefficients: list[float] = field(default_factory=lambda: [0.0, 0.0, 0.0, -3.0])


class Finder:
    """Hits of a model's lexicon in texts."""

    def __init__(self, model: Model):
        self.model = model
        self.machine = Machine(sorted(w for w in model.weights if not w.endswith("*")))
        self.stems = {w[:-1] for w in model.weights if w.endswith("*")}
        self.known = Lately(self.of_piece, 150_000)

    def of_word(self, word: str) -> tuple[str, float, int] | None:
        """(term, weight, edits)"""
        weights = self.model.weights
        if word in weights:
            return word, weights[word], 0
        best = None
        for n in STEMS:
            if word[:n] in self.stems and len(word) >= n:
                best = max(best or (0.0, ""), (weights[word[:n] + "*"], word[:n] + "*"))
        near = self.machine.nearest(word) if word not in self.model.harmless else None
        if near and near[0]:
            term = self.machine.terms[near[1]]
            weight = weights[term] * (1 - 0.15 * near[0])
            if best is None or weight > best[0]:
                return term, weight, near[0]
        return (best[1], best[0], 0) if best else None

    def of_piece(self, piece: str) -> tuple:
        """The strongest hit in a piece of text without white space; the last value is the word itself."""
        if piece.isalpha():
            words = [piece]
        elif piece[:-1].isalpha():
            words = [piece[:-1]]
        else:
            words = WORD.findall(piece)
            core = EDGE.sub("", piece)
            if core not in words:
                words.append(core)
        hits = [(*h, w) for w in words if (h := self.of_word(w))]
        return max(hits, key=lambda h: h[1]) if hits else ()

    def hits(self, text: str | None) -> tuple[list[tuple], int]:
        """((term, weight, edits, word, mention) ..., number of pieces); mention: by its context it is quoted or reported."""
        pieces = (text or "").lower().split()
        known = self.known
        found = [known[p] for p in pieces]
        return [(*hit, self.mention(pieces, i)) for i, hit in enumerate(found) if hit], len(pieces)

    @staticmethod
    def mention(pieces: list[str], i: int) -> bool:
        before, after = pieces[max(0, i - WINDOW) : i + 1], pieces[i : i + 1 + WINDOW]
        if any(p[0] in OPENING for p in before) and any(p.rstrip(".,;:!?")[-1:] in tuple(CLOSING) for p in after):
            return True
        return any(EDGE.sub("", p) in REPORTING for p in (*before[:-1], *after[1:]))

    @staticmethod
    def features(hits: list[tuple], n: int) -> tuple[float, float, float]:
        """The strongest hit, the log of all distinct hits' weights, and their sum by the root of the length."""
        best: dict[str, float] = defaultdict(float)
        for term, weight, _, word, mention in hits:
            name = word if term.endswith("*") else term
            best[name] = max(best[name], weight * (MENTION if mention else 1))
        total = sum(best.values())
        return max(best.values(), default=0.0), float(np.log1p(total)), total / (n + 1) ** 0.5

    def score(self, text: str | None) -> float:
        hits, n = self.hits(text)
        a, b, c, d = self.model.coefficients
        x, y, z = self.features(hits, n)
        return float(1 / (1 + np.exp(-(a * x + b * y + c * z + d))))


def sampled(docs: DataFrame, labels: DataFrame, label: str, rows: int, train: Column | None) -> DataFrame:
    """Texts and labels of at most ``rows`` documents of each class, those with the smallest hashes of their ids."""
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    usable = (usable.where(train) if train is not None else usable).groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = [usable.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for y in (0, 1)]
    return docs.join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id").select("text", "y")


def term_counts(sample: DataFrame) -> DataFrame:
    """term, with, without: documents of each class that hold each word or stem."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for b in batches:
            for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
                words = set(WORD.findall((text or "").lower()))
                counts[y].update(w for w in words if len(w) >= 3)
                counts[y].update({w[:n] + "*" for w in words for n in STEMS if len(w) > n})
        terms = list(counts[0].keys() | counts[1].keys())
        for i in range(0, max(1, len(terms)), 50_000):
            part = terms[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([counts[y][t] for t in part], pa.int64()) for y in (1, 0))], ["term", "with", "without"])

    return sample.mapInArrow(releasing(run), "term string, with long, without long").groupBy("term").agg(F.sum("with").alias("with"), F.sum("without").alias("without"))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.01) -> list[float]:
    """Newton's method; slopes are not let below 0, as a hit never speaks for a document."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    active = np.ones(len(w), bool)
    for _ in range(4):
        w[:] = 0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = (x.T @ (weight * (p - y)) + ridge * w) * active
            h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
            h[~active] = 0
            h[:, ~active] = 0
            h += np.diag((~active).astype(float))
            step = np.linalg.solve(h, g)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        low = (w < 0) & active
        low[-1] = False
        if not low.any():
            break
        active &= ~low
    return [float(v) for v in w]


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = 5000, terms: int = 2000, train: Column | None = None, odds: float = 2.0, support: int = 4) -> Model:
    """Fits on at most ``rows`` documents of each class. ``terms`` bounds the words and, apart from them, the stems. Without labels of both kinds nothing is toxic."""
    sample = stored(sampled(docs, labels, label, rows, train), "toxicity-sample")
    size = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not (size.get(0) and size.get(1)):
        forget(sample)
        return Model({})
    lift = F.log((F.col("with") + 0.5) / (size[1] + 1)) - F.log((F.col("without") + 0.5) / (size[0] + 1))
    counted = stored(term_counts(sample).where(F.col("with") >= support).withColumn("w", lift).where(F.col("w") >= odds), "toxicity-terms")
    stem = F.col("term").endswith("*")
    words, stems = ({r["term"]: r["w"] for r in counted.where(of).orderBy(F.desc(F.col("w") * F.log1p("with")), "term").limit(terms).collect()} for of in (~stem, stem))
    forget(counted)
    model = Model(words | uncovered(stems))

    def near_words(batches) -> Iterator[pa.RecordBatch]:
        finder, words = Finder(model), set()
        for b in batches:
            for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
                words.update(h[3] for h in finder.hits(text)[0] if h[2] and not y)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string())], ["word"])

    model.harmless = frozenset(r["word"] for r in sample.mapInArrow(releasing(near_words), "word string").distinct().collect())

    def features(batches) -> Iterator[pa.RecordBatch]:
        finder = Finder(model)
        for b in batches:
            rows = [Finder.features(*finder.hits(t)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("y"), *(pa.array([r[i] for r in rows], pa.float64()) for i in range(3))], ["y", "a", "b", "c"])

    got = np.array([tuple(r) for r in sample.mapInArrow(releasing(features), "y int, a double, b double, c double").collect()], float)
    forget(sample)
    model.coefficients = logistic(got[:, 1:], got[:, 0], np.ones(len(got)))
    return model


def uncovered(weights: dict[str, float], enough: float = 0.6) -> dict[str, float]:
    """The stems without those that a shorter one stands for: one with at least ``enough`` of their weight. Words all stay: misspelled, they need not begin with a stem."""
    out: dict[str, float] = {}
    for term, weight in sorted(weights.items(), key=lambda x: len(x[0].rstrip("*"))):
        word = term.rstrip("*")
        stems = [word[:n] + "*" for n in STEMS if n <= len(word) and word[:n] + "*" != term]
        if not any(out.get(s, 0.0) >= enough * weight for s in stems):
            out[term] = weight
    return out


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", at: float = 0.7) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if score >= ``at``) of each whole text; null and empty texts hold no hits."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        finder = Finder(model)
        for b in batches:
            scores = [finder.score(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64()), pa.array([int(s >= at) for s in scores], pa.int32())], ["doc_id", "score", "predicted"])

    small_batches(df.sparkSession)
    return docs_of(df, id_col, text_col).mapInArrow(releasing(run), "doc_id long, score double, predicted int")


def toxicity(df: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """doc_id, held_out, score, predicted: learned from the labels of all folds but ``held``, one row per row of ``df``.

    Rows without an id are scored like all others (their fold is that of the empty text), but carry no label; rows that repeat an
    id are scored each, and each learned from. Of labels that contradict each other 1 counts. Between terms equally near to a word the first in
    order counts, between equally frequent ones the first too.
    """
    docs = docs_of(df, id_col, text_col)
    small_batches(df.sparkSession)
    model = learn(docs, labels, train=fold(F.col("doc_id"), folds) != held, **how)
    return score(docs, model).select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "score", "predicted")


def clean_documents(docs: DataFrame, labels: DataFrame, at: float = 0.7, **how) -> DataFrame:
    """The rows of ``docs`` that are not toxic, with all their columns: one pass, without a shuffle of texts."""
    names = docs.columns
    model = learn(docs_of(docs), labels, train=fold(F.col("doc_id"), 3) != 1, **how)
    place = names.index("text")

    def run(batches) -> Iterator[pa.RecordBatch]:
        finder = Finder(model)
        for b in batches:
            yield b.filter(pa.array([finder.score(t) < at for t in b.column(place).to_pylist()], pa.bool_()))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(releasing(run), docs.schema)
