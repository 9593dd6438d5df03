"""Quality by importance resampling: hashed n-gram models of target and raw text, and Gumbel top-k.

Unigrams and bigrams of words and marks fall into ``buckets`` by hash. The raw model counts all documents; the target
model counts a bounded sample of documents labelled good. A document's log weight is the sum of the buckets' log
ratios over its n-grams; the weight plus Gumbel noise, fixed by the document's id, orders the documents, and the
first k are a sample without replacement in proportion to the weights.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import Lately
from .common import docs_of, fold, small_batches, stored
from .toxicity import sampled

TOKENS = re.compile(r"\w+|[^\w\s]+")


class NGrams:
    """Buckets of a text's n-grams."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.known = Lately(lambda piece: tuple([zlib.crc32(t.encode()) for t in TOKENS.findall(piece)]), 200_000)

    def of(self, text: str | None) -> np.ndarray:
        known = self.known
        h = np.array([x for p in (text or "").split() for x in known[p]], np.uint64)
        pairs = (h[:-1] * np.uint64(0x9E3779B1) + h[1:] * np.uint64(0x85EBCA77)) >> np.uint64(7)
        return (np.concatenate([h, pairs]) % np.uint64(self.buckets)).astype(np.int64)


def counted(docs: DataFrame, buckets: int) -> np.ndarray:
    """n-grams in each bucket over all documents: one row of counts per task and bucket is summed."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        grams, total = NGrams(buckets), np.zeros(buckets, np.int64)
        for b in batches:
            for text in b.column("text").to_pylist():
                total += np.bincount(grams.of(text), minlength=buckets) if text and len(text) > 4 * buckets else 0
                if text and len(text) <= 4 * buckets:
                    np.add.at(total, grams.of(text), 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    out = np.zeros(buckets)
    for r in docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def threshold(keys: DataFrame, k: int, enough: int = 10_000) -> tuple[float, int] | None:
    """(key, doc_id) of the k-th row by descending key, then ascending id: histograms narrow the range until few rows are left."""
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    above = 0
    if k <= 0 or not n:
        return None
    k = min(k, n)
    while n > enough and high > low:
        width = (high - low) / 1024
        if low + width == low:
            break
        bin_of = F.least(F.floor((F.col("key") - low) / width), F.lit(1023))
        counts = {r["b"]: r["n"] for r in keys.where(F.col("key").between(low, high)).groupBy(bin_of.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
        b = 1023
        while above + counts.get(b, 0) < k:
            above += counts.get(b, 0)
            b -= 1
        n = counts[b]
        keys = keys.where(F.col("key").between(low, high) & (bin_of == b))
        low, high = keys.agg(F.min("key"), F.max("key")).first()
    last = keys.orderBy(F.desc("key"), F.asc_nulls_last("doc_id")).limit(k - above).agg(F.min(F.struct("key", (-F.col("doc_id")).alias("back"))).alias("last")).first()["last"]
    return last["key"], -last["back"] if last["back"] is not None else None


def quality(df: DataFrame, labels: DataFrame, label: str = "quality", fraction: float | None = None, rows: int = 5000, buckets: int = 20_000, seed: int = 1, train: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, log_weight, score, n_grams, key, kept, one row per row of ``df``.

    ``kept`` marks the ``fraction`` of rows with the largest keys; by default that is the share of label 1 among the labels.
    ``score`` (0 to 1) is the logistic of the mean log ratio of an n-gram, times 10. Null and empty texts have log weight 0 and
    no n-grams. Rows that repeat an id and text have equal keys and are kept or left together. ``rows`` bounds
    the labelled sample. Without labels all weights are 0 and every row is kept.
    """
    spark = df.sparkSession
    small_batches(spark)
    docs = docs_of(df, id_col, text_col)
    usable = labels.where(train) if train is not None else labels
    shares = usable.where(F.col(label).isin(0, 1)).agg(F.count(F.lit(1)), F.sum(F.col(label).cast("long"))).first()
    if fraction is None:
        fraction = shares[1] / shares[0] if shares[0] else 1.0
    target = counted(sampled(docs, usable, label, rows, None).where("y = 1"), buckets)
    raw = counted(docs, buckets)
    ratio = np.log((target + 1) / (target.sum() + buckets)) - np.log((raw + 1) / (raw.sum() + buckets)) if target.sum() else np.zeros(buckets)

    def run(batches) -> Iterator[pa.RecordBatch]:
        grams = NGrams(buckets)
        for b in batches:
            found = [(ratio[g].sum(), len(g)) for g in map(grams.of, b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([float(x[0]) for x in found], pa.float64()), pa.array([x[1] for x in found], pa.int64())], ["doc_id", "log_weight", "n_grams"])

    weighed = docs.mapInArrow(run, "doc_id long, log_weight double, n_grams long")
    uniform = (F.pmod(F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1))), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    keys = stored(weighed.withColumn("key", F.col("log_weight") - F.log(-F.log(uniform))), "quality-keys")
    cut = threshold(keys.select("doc_id", "key"), math.ceil(fraction * keys.count()))
    kept = F.lit(False)
    if cut:
        kept = (F.col("key") > cut[0]) | ((F.col("key") == cut[0]) & (F.lit(True) if cut[1] is None else F.col("doc_id") <= cut[1]))
    mean = F.col("log_weight") / F.greatest("n_grams", F.lit(1))
    return keys.select("doc_id", "log_weight", (1 / (1 + F.exp(-10 * mean))).alias("score"), "n_grams", "key", F.coalesce(kept, F.lit(False)).alias("kept"))


def query(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``quality`` learned from two folds of three, with ``held_out`` for the third."""
    out = quality(documents, labels, train=fold(F.col("doc_id"), 3) != 1)
    return out.withColumn("held_out", fold(F.col("doc_id"), 3) == 1)
