"""Scoring texts with a log-bilinear neural model.

Words are counted over all training documents. The model predicts the class of each token from the classes of the
tokens before it: the predicted vector is the sum of one matrix per position times the vectors of those classes
(kept multiplied out, as one table per position). Classes are dealt into about as many clusters as a cluster has
classes, by frequency; products with the clusters' vectors, plus biases, give a softmax over clusters, and products with
the vectors of one cluster's classes a softmax within it, so that a token costs two square roots of the number of classes.

Frequent words and a text's end are classes of their own; their number grows with the cube root of the training tokens.
Any other word belongs to a class by its last letters, and has within it the share (c + 1) / (N + V + 1) of the
class's counts, so that probabilities over all words, and one unknown word per class, sum to 1.

Training is noise-contrastive estimation in numpy at both levels, with noise from the counts: every task trains on its part of
the training documents, from the same start, and each class's parameters are averaged by how often the tasks met the class;
``rounds`` times. All training documents are trained on, in every round.

Counts of at most ``hot`` frequent words go to every task; the counts of all others are joined
to the words of documents in a shuffle, so no vocabulary ever has to fit in a task.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import docs_of, fold, small_batches, stored

def words(text: str | None) -> list[bytes]:
    """A-Z in lower case, cut at ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class Classes:
    """Classes of words: the end, one for each of the ``own`` words, ``shared`` ones by the last three bytes; numbered by ``ranked``."""

    def __init__(self, own: list[bytes], shared: int):
        self.own = {w: i + 1 for i, w in enumerate(own)}
        self.first, self.shared = len(own) + 1, shared
        self.size = self.first + shared
        self.end, self.numbers = 0, list(range(self.first, self.size))

    def of(self, word: bytes) -> int:
        own = self.own.get(word)
        return self.numbers[zlib.crc32(word[-3:]) % self.shared] if own is None else own

    def of_all(self, words: list[bytes]) -> np.ndarray:
        """``of`` for each of many words."""
        get, shared, crc = self.own.get, self.shared, zlib.crc32
        out = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        others = np.flatnonzero(out < 0)
        out[others] = np.array(self.numbers)[[crc(words[i][-3:]) % shared for i in others.tolist()]] if len(others) else 0
        return out

    def ranked(self, totals: np.ndarray) -> np.ndarray:
        """Numbers all classes anew, the most frequent first; gives the old number of each."""
        old = np.argsort(-totals, kind="stable")
        new = np.empty(self.size, np.int64)
        new[old] = np.arange(self.size)
        self.own = {w: int(new[i]) for w, i in self.own.items()}
        self.numbers = [int(new[i]) for i in self.numbers]
        self.end = int(new[self.end])
        return old


class Model:
    """The log-bilinear model over classes: ``before[i]`` maps the class i + 1 places before to its part of the prediction.

    share: of each class, the most frequent first. Without training the model is that of the shares alone, or nearly so.
    """

    def __init__(self, share: np.ndarray, dim: int, order: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        n = len(share)
        self.width = math.isqrt(n - 1) + 1  # classes in a cluster
        self.clusters = -(-n // self.width)
        self.before = (rng.standard_normal((order, n, dim)) * 0.05).astype(np.float32)
        self.vectors = (rng.standard_normal((n, dim)) * 0.05).astype(np.float32)
        self.tops = (rng.standard_normal((self.clusters, dim)) * 0.05).astype(np.float32)
        #: shares of clusters, and of classes within their clusters: the noise of both levels
        self.top_share = np.add.reduceat(share, np.arange(0, n, self.width))
        self.share = share / np.repeat(self.top_share, self.width)[:n]
        self.bias, self.top_bias = np.log(self.share).astype(np.float32), np.log(self.top_share).astype(np.float32)

    def predicted(self, context: np.ndarray) -> np.ndarray:
        q = self.before[0].take(context[0], 0)
        for i in range(1, len(self.before)):
            q += self.before[i].take(context[i], 0)
        return q

    def log_probabilities(self, context: np.ndarray, target: np.ndarray, at_once: int = 1024) -> np.ndarray:
        """Natural logs, normalised over all classes.

        Tokens are taken by the cluster of their class, ``at_once`` at a time: one product gives their scores for all clusters and
        for all classes of their own cluster, a row per score, and all that is computed of them fits a core's cache.
        """
        out, cluster, dim, n_tops = np.empty(len(target), np.float32), target // self.width, self.vectors.shape[1], self.clusters
        order, edges = np.argsort(short(cluster, n_tops), kind="stable"), np.append(0, np.cumsum(np.bincount(cluster, minlength=n_tops)))
        weights = np.empty((n_tops + self.width, dim + 1), np.float32)  # biases in the last column
        weights[:n_tops, :dim], weights[:n_tops, dim] = self.tops, self.top_bias
        space, qs = np.empty((n_tops + self.width) * at_once, np.float32), np.ones((at_once, dim + 1), np.float32)
        for k in np.flatnonzero(np.diff(edges)).tolist():
            low = k * self.width
            own = self.vectors[low : low + self.width]
            w = weights[: n_tops + len(own)]
            w[n_tops:, :dim], w[n_tops:, dim] = own, self.bias[low : low + self.width]
            for at in range(edges[k], edges[k + 1], at_once):
                some = order[at : min(at + at_once, edges[k + 1])]
                n = len(some)
                qs[:n, :dim] = self.predicted(context.take(some, 1))
                scores = np.matmul(w, qs[:n].T, out=space[: len(w) * n].reshape(len(w), n))
                goal = scores[k] + scores[target.take(some) + (n_tops - low), np.arange(n)]
                out[some] = goal - log_sum(scores[:n_tops]) - log_sum(scores[n_tops:])
        return out

    def train(self, context: np.ndarray, target: np.ndarray, rng: np.random.Generator, rate: float, negatives: int = 16, inner: int = 1, batch: int = 8192) -> None:
        """One pass of noise-contrastive estimation with steps as in Adagrad.

        All tokens of a batch share ``negatives`` noise clusters; each token has ``inner`` noise classes of its own cluster.
        """
        if not hasattr(self, "sums"):
            self.sums = {name: np.full(getattr(self, name).shape[: 2 if name == "before" else 1], 1e-2, np.float32) for name in ("before", "vectors", "tops", "bias", "top_bias")}
        top_noise = (np.log(self.top_share) + np.log(negatives)).astype(np.float32)
        noise = (np.log(self.share) + np.log(inner)).astype(np.float32)
        top_cut, cut = np.cumsum(self.top_share), np.append(0.0, np.cumsum(self.share))
        places = Places(cut)
        for at in rng.permutation(np.arange(0, len(target), batch)):
            c, w = context[:, at : at + batch], target[at : at + batch]
            n, q, cluster = len(w), self.predicted(c), w // self.width
            # clusters
            some = np.minimum(np.searchsorted(top_cut, rng.random(negatives) * top_cut[-1]), self.clusters - 1)
            own, other = self.tops.take(cluster, 0), self.tops.take(some, 0)
            true = sigmoid(np.einsum("nd,nd->n", q, own) + (self.top_bias - top_noise).take(cluster)) - 1
            false = sigmoid(q @ other.T + (self.top_bias - top_noise).take(some))
            dq = true[:, None] * own + false @ other
            rows = np.concatenate([cluster, some])
            top_grads = np.concatenate([true[:, None] * q, false.T @ q]), np.concatenate([true, false.sum(0)])
            # classes within clusters
            low = cluster * self.width
            high = np.minimum(low + self.width, len(self.bias))
            draws = cut[low][:, None] + rng.random((n, inner)) * (cut[high] - cut[low])[:, None]
            drawn = np.clip(places.of(draws.ravel()), np.repeat(low, inner), np.repeat(high - 1, inner))
            both = np.concatenate([w[:, None], drawn.reshape(n, inner)], 1)
            vectors = self.vectors.take(both, 0)
            slope = sigmoid(np.einsum("nkd,nd->nk", vectors, q) + (self.bias - noise).take(both))
            slope[:, 0] -= 1
            dq += np.einsum("nk,nkd->nd", slope, vectors)
            self.descend("tops", rows, top_grads[0], rate)
            self.descend("top_bias", rows, top_grads[1], rate)
            flat = both.ravel()
            self.descend("vectors", flat, (slope[:, :, None] * q[:, None, :]).reshape(len(flat), -1), rate)
            self.descend("bias", flat, slope.ravel(), rate)
            for i in range(len(c)):
                self.descend("before", c[i], dq, rate, i)

    def descend(self, name: str, rows: np.ndarray, grads: np.ndarray, rate: float, at: int | None = None) -> None:
        """A step for some rows of a table, each with a rate of its own; rows that repeat are added up first."""
        table, sums = getattr(self, name), self.sums[name]
        if at is not None:
            table, sums = table[at], sums[at]
        some, g = sums_by(rows, grads, len(table))
        now = sums.take(some) + (np.einsum("rd,rd->r", g, g) / g.shape[1] if g.ndim > 1 else g * g)
        sums[some] = now
        steps = (rate / np.sqrt(now)).astype(np.float32)
        g *= steps[:, None] if g.ndim > 1 else steps
        table[some] = table.take(some, 0) - g

    # --- parameters as rows: those of classes, then those of clusters

    def rows(self, of: np.ndarray) -> np.ndarray:
        n, dim = self.vectors.shape
        k = of[of < n]
        classes = np.concatenate([self.before[:, k].transpose(1, 0, 2).reshape(len(k), len(self.before) * dim), self.vectors[k], self.bias[k, None]], 1)
        t = of[of >= n] - n
        clusters = np.zeros((len(t), classes.shape[1]), np.float32)
        clusters[:, :dim], clusters[:, dim] = self.tops[t], self.top_bias[t]
        return np.concatenate([classes, clusters])

    def put(self, of: np.ndarray, rows: np.ndarray) -> None:
        n, dim = self.vectors.shape
        order = len(self.before)
        k, got = of[of < n], rows[of < n]
        self.before[:, k] = got[:, : order * dim].reshape(len(k), order, dim).transpose(1, 0, 2)
        self.vectors[k], self.bias[k] = got[:, order * dim : -1], got[:, -1]
        t, got = of[of >= n] - n, rows[of >= n]
        self.tops[t], self.top_bias[t] = got[:, :dim], got[:, dim]


def sigmoid(x: np.ndarray) -> np.ndarray:
    np.clip(x, -40, 40, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def log_sum(scores: np.ndarray) -> np.ndarray:
    """The log of the sum of the exponentials of each column; ``scores`` are overwritten."""
    top = None
    if not (scores.max() < 60 and scores[0].min() > -60):  # else no sum is 0 or too large
        top = scores.max(0)
        scores -= top
    np.exp(scores, out=scores)
    out = np.log(scores.sum(0))
    return out if top is None else out + top


class Places:
    """``np.searchsorted(cut, x, "right") - 1`` for many x from 0 on, from the place of the 256th below each x on: faster than a search by halves."""

    def __init__(self, cut: np.ndarray):
        self.cut = np.append(cut, np.inf)
        self.first = np.searchsorted(cut, np.arange(int(cut[-1] * 256) + 2) / 256, "right") - 1

    def of(self, x: np.ndarray) -> np.ndarray:
        out = self.first.take((x * 256).astype(np.int64), mode="clip")
        while (more := self.cut.take(out + 1) <= x).any():
            out += more
        return out


def short(numbers: np.ndarray, end: int) -> np.ndarray:
    """The same numbers, all below ``end``, in 16 bits if those will do: they sort much faster."""
    return numbers.astype(np.uint16) if end <= 65536 else numbers


def sums_by(rows: np.ndarray, grads: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows (all below ``end``), and the sum of the grads of each.

    ``np.add.at`` over single numbers, or two of them as a complex one, takes a third of the time of sorting and ``np.add.reduceat``.
    """
    found = np.flatnonzero(np.bincount(rows, minlength=end))
    if grads.ndim == 1:
        return found, np.bincount(rows, grads, end)[found].astype(grads.dtype)
    out = np.zeros((len(found), grads.shape[1]), np.float32)
    kind = np.float32 if grads.shape[1] % 2 else np.complex64
    wide = out.view(kind).shape[1]
    place = np.empty(end, np.int64)
    place[found] = np.arange(len(found))
    places = np.arange(len(found) * wide).reshape(len(found), wide).take(place.take(rows), 0)
    np.add.at(out.view(kind).reshape(-1), places.reshape(-1), np.ascontiguousarray(grads).view(kind).reshape(-1))
    return found, out


def contexts(classes: np.ndarray, starts: np.ndarray, order: int, end: int) -> np.ndarray:
    """Row i: the classes i + 1 places before each token; ``end`` before a text's beginning. starts: each token's text's first token."""
    place = np.arange(len(classes)) - starts
    out = np.zeros((order, len(classes)), classes.dtype)
    for i in range(order):
        out[i, i + 1 :] = classes[: max(0, len(classes) - i - 1)]
        out[i, place <= i] = end
    return out


def counts_of(docs: DataFrame, most: int = 200_000) -> DataFrame:
    """word (binary), c: over all rows; each task adds up what it can hold before words are exchanged."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out():
            got = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "c"])
            held.clear()
            return got

        for b in slices(batches, 4 << 20):
            codes, names, _ = split(b.column("text"))
            for w, c in zip(names, np.bincount(codes, minlength=len(names)).tolist(), strict=True):
                if c:  # a blank is no word
                    held[w] += c
            if len(held) >= most:
                yield out()
        yield out()

    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Scorer:
    """What a task needs: classes, hot words' counts, class totals, and the model."""

    def __init__(self, classes: Classes, hot: dict[bytes, int], totals: np.ndarray, kinds: np.ndarray, model: Model | None):
        self.classes, self.model = classes, model
        self.hot = hot
        #: log10 of what shares within a class are divided by; a word that is a class has the share 1
        self.within = np.full(classes.size, np.nan)
        self.within[classes.numbers] = np.log10(totals + kinds + 1)[classes.numbers]

    def batch(self, texts: pa.Array) -> list[np.ndarray | pa.Array]:
        """Columns: n_tokens, hot n, hot sum of log10(c + 1), score without rare words' counts, rare words, their numbers in the text."""
        classes, n = self.classes, len(texts)
        codes, names, offsets = split(texts)
        get = self.known.get
        place = np.fromiter((get(w, -1) for w in names), np.int64, len(names))
        hit, rare = np.flatnonzero(place >= 0), place < 0
        place, others = place[hit], np.flatnonzero(rare)
        kinds, log_c, add = np.empty(len(names), np.int64), np.zeros(len(names)), np.empty(len(names))
        kinds[hit], log_c[hit], add[hit] = self.kinds[place], self.logs[place], self.shares[place]
        kinds[others] = classes.of_all([names[i] for i in others.tolist()])
        add[others] = -self.within[kinds[others]]
        # a text's words and its end
        sizes = np.diff(offsets) + 1
        ends = np.cumsum(sizes)
        owner = np.repeat(np.arange(n), sizes - 1)
        target = np.full(int(ends[-1]), classes.end, np.int64)
        target[np.arange(len(codes)) + owner] = kinds[codes]
        logs = self.model.log_probabilities(contexts(target, np.repeat(ends - sizes, sizes), len(self.model.before), classes.end), target).astype(np.float64)
        score = np.add.reduceat(logs, ends - sizes) / np.log(10) + np.bincount(owner, add[codes], n)
        # each text's distinct rare words
        is_rare = rare[codes]
        pairs, times = np.unique(owner[is_rare] * max(1, len(names)) + codes[is_rare], return_counts=True)
        of, word = np.divmod(pairs, max(1, len(names)))
        at = pa.array(np.searchsorted(of, np.arange(n + 1)).astype(np.int32))
        rare_words = pa.ListArray.from_arrays(at, pa.array(names, pa.binary()).take(pa.array(word)))
        known = sizes - 1 - np.bincount(owner[is_rare], minlength=n)
        return [sizes, known, np.bincount(owner, log_c[codes], n), score, rare_words, pa.ListArray.from_arrays(at, pa.array(times.astype(np.int64)))]

    def ready(self) -> Scorer:
        """With each hot word's class, log10(c + 1) and log10 of its share within its class, once per task."""
        own, n = self.classes.own, len(self.hot)
        self.known = {w: i for i, w in enumerate(self.hot)}
        self.kinds = self.classes.of_all(list(self.hot))
        self.logs = np.log10(np.fromiter(self.hot.values(), np.float64, n) + 1)
        self.shares = np.where(np.fromiter((w in own for w in self.hot), bool, n), 0.0, self.logs - self.within[self.kinds])
        return self


def frequent(counts: DataFrame, most: int) -> dict[bytes, int]:
    """At most ``most`` of the most frequent words with their counts, the most frequent first: a histogram of counts tells
    from which count on words are few enough, and only those leave the cluster."""
    place = F.floor(F.log2("c") * 32)
    above, low = 0, -1
    for r in sorted(counts.groupBy(place.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        above += r["n"]
        if above > most:
            low = r["p"]
            break
    found = counts.where(place > low).collect()
    return {bytes(r["word"]): r["c"] for r in sorted(found, key=lambda r: (-r["c"], bytes(r["word"])))}


def log_bilinear_scores(
    df: DataFrame, train: Column, hot: int = 100_000, own: int | None = None, shared: int = 512, dim: int = 24, order: int = 3, rounds: int = 1, rate: float = 0.1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, one row per row of ``df``.

    ``train`` (of doc_id) says which documents are learned from. Null and empty texts are one token, the end. Repeated rows
    are scored each, and counted each, as are rows without an id (their fold is that of the empty text). Without training
    documents all words are unknown and classes alike likely. ``own``: how many words are classes of their own, at most
    ``hot``; by default 24 times the cube root of the number of training tokens. ``shared``: classes of all other words.
    """
    spark = df.sparkSession
    small_batches(spark)
    docs = docs_of(df, id_col, text_col)
    learned = docs.where(train)
    counts = stored(counts_of(learned), "lm-counts")
    ends = learned.count()
    seen = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    tokens, types = seen[0] + ends, seen[1] + (1 if ends else 0)
    known = frequent(counts, hot)
    classes = Classes(list(known)[: int(24 * tokens ** (1 / 3)) if own is None else own], shared)

    def totals_of(batches) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(classes.size, np.int64), np.zeros(classes.size, np.int64)
        for b in batches:
            ids = np.array([classes.of(w) for w in b.column("word").to_numpy(zero_copy_only=False)], np.int64)
            n += np.bincount(ids, b.column("c").to_numpy(), classes.size).astype(np.int64)
            v += np.bincount(ids, minlength=classes.size)
        yield pa.RecordBatch.from_arrays([pa.array(range(classes.size), pa.int32()), pa.array(n), pa.array(v)], ["k", "n", "v"])

    totals, kinds = np.zeros(classes.size), np.zeros(classes.size)
    for r in counts.mapInArrow(totals_of, "k int, n long, v long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        totals[r["k"]], kinds[r["k"]] = r["n"], r["v"]
    totals[classes.end] = ends
    old = classes.ranked(totals)
    totals, kinds = totals[old], kinds[old]
    model = Model((totals + 1) / (totals + 1).sum(), dim, order)
    for turn in range(rounds):
        model = averaged(learned.select("text"), classes, model, rate / (turn + 1), turn)
    scorer = Scorer(classes, known, totals, kinds, model)
    del known

    def run(batches) -> Iterator[pa.RecordBatch]:
        s = scorer.ready()
        names = ["doc_id", "n_tokens", "n", "log_c", "score", "rare", "times"]
        for b in slices(batches, 4 << 20):
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, s.batch(b.column("text")))], names)

    scored = docs.mapInArrow(run, "doc_id long, n_tokens long, n long, log_c double, score double, rare array<binary>, times array<long>")
    scored = stored(scored.withColumn("row", F.monotonically_increasing_id()), "lm-scored")
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("word"), F.col("w.times").alias("m"))
    cold = rare.join(counts, "word").groupBy("row").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.log10(F.col("c") + 1)).alias("l"))
    return scored.select("row", "doc_id", "n_tokens", "n", "log_c", "score").join(cold, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n") + F.coalesce("m", F.lit(0)) + F.lit(1 if ends else 0)).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("log_c") + F.coalesce("l", F.lit(0.0)) + F.lit(float(np.log10(ends + 1))) - F.col("n_tokens") * F.lit(float(np.log10(tokens + types + 1)))).alias("base_score"),
        (F.col("score") + F.coalesce("l", F.lit(0.0))).alias("score"),
    )


def averaged(learned: DataFrame, classes: Classes, model: Model, rate: float, turn: int, at_once: int = 1 << 20) -> Model:
    """Every task trains on its documents from ``model``; each class's mean parameters over tasks, weighted by its tokens there.

    A task gives only the rows of classes that it met. Rows of one class are added up in tasks, so the driver gets each class once.
    ``at_once``: tokens that are trained on together.
    """
    order, n_classes = len(model.before), classes.size

    def run(batches) -> Iterator[pa.RecordBatch]:
        own, held, size, rng = model, [], 0, np.random.default_rng(turn)
        seen = np.zeros(n_classes, np.int64)

        def learn():
            sizes = np.array([len(h) for h in held])
            target = np.concatenate(held)
            own.train(contexts(target, np.repeat(np.cumsum(sizes) - sizes, sizes), order, classes.end), target, rng, rate)
            held.clear()
            np.add(seen, np.bincount(target, minlength=n_classes), out=seen)

        for b in slices(batches, 4 << 20):
            flat, sizes = class_ids(b.column("text"), classes)
            held += np.split(flat, np.cumsum(sizes)[:-1])
            size += len(flat)
            if size >= at_once:
                learn()
                size = 0
        if held:
            learn()
        weight = np.concatenate([seen, np.add.reduceat(seen, np.arange(0, n_classes, own.width))])
        k = np.flatnonzero(weight)
        values = own.rows(k) * weight[k, None].astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(weight[k].astype(np.float64)), pa.array([v.tobytes() for v in values], pa.binary())], ["k", "weight", "row"])

    def added(batches) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        weights: dict[int, float] = {}
        for b in batches:
            for k, weight, row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                values = np.frombuffer(row, np.float32).astype(np.float64)
                weights[k] = weights.get(k, 0.0) + weight
                sums[k] = sums[k] + values if k in sums else values
        keys = list(sums)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([(sums[k] / weights[k]).astype(np.float32).tobytes() for k in keys], pa.binary())], ["k", "row"])

    rows = learned.select("text").mapInArrow(run, "k int, weight double, row binary").repartition("k").mapInArrow(added, "k int, row binary").collect()
    if rows:
        model.put(np.array([r["k"] for r in rows]), np.frombuffer(b"".join(bytes(r["row"]) for r in rows), np.float32).reshape(len(rows), -1))
    return model


def class_ids(texts: pa.Array, classes: Classes) -> tuple[np.ndarray, np.ndarray]:
    """The classes of all texts' words, with an end after each text, and the number of tokens of each text."""
    codes, names, offsets = split(texts)
    kinds = classes.of_all(names)
    sizes = np.diff(offsets) + 1
    out = np.full(int(sizes.sum()), classes.end, np.int64)
    out[np.arange(len(codes)) + np.repeat(np.arange(len(sizes)), sizes - 1)] = kinds[codes] if len(codes) else 0
    return out, sizes


def split(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Words of a batch: their numbers among the distinct ones, the distinct ones, and where each text's words begin and end."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("").cast(pa.large_string())))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    found = lists.flatten().dictionary_encode()
    codes = found.indices.to_numpy().astype(np.int64)
    names = found.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()  # much faster than to_pylist()
    if b"" in names:  # before, after or instead of white space
        some = codes != names.index(b"")
        offsets, codes = np.append(0, np.cumsum(some))[offsets], codes[some]
    return codes, names, offsets


def scores(df: DataFrame, folds: int = 7, held: int = 2, **how) -> DataFrame:
    """``log_bilinear_scores`` learned from all folds but ``held``, with ``held_out``."""
    out = log_bilinear_scores(df, fold(F.col("doc_id"), folds) != held, **how)
    return out.select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
