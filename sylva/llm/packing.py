"""Packing token sequences with Karmarkar-Karp multiway differencing.

A document's ids are cut into full windows and a rest; the rest is cut into pieces of at most ``piece`` ids. Each
task gathers the pieces of ``group`` documents and partitions them into k windows of nearly equal length: every piece
starts as a partial partition of k windows with one filled; the two partial partitions with the largest
differences are merged, the fullest window of one with the emptiest of the other, until one is left. k starts at
the least number that could do and rises while a window is over capacity.

There is no shuffle: a task packs what it reads, and its partition's number makes its window numbers unique.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import batch_ids, slices
from .common import docs_of, small_batches
from .library_ids import library_ids

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """k lists of indices into ``sizes`` whose sums are nearly equal.

    A partial partition is a list of (sum, members), largest sum first, without the windows that are still at its
    smallest sum of 0; sums are kept relative to the smallest.
    """
    if k == 1:
        return [list(range(len(sizes)))]
    heap = [(-size, i, [(size, (i,))]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        over = len(a) + len(b) - k
        if over <= 0:  # windows enough for both
            merged = sorted(a + b, key=lambda w: -w[0])
        else:  # the fullest of a meets the emptiest of b: the last `over` of a and of b pair up crosswise
            alone = k - len(b)
            merged = a[:alone] + [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a[alone:], reversed(b[k - len(a) :]), strict=True)] + b[: k - len(a)]
            merged.sort(key=lambda w: -w[0])
        if len(merged) == k:
            least = merged[-1][0]
            merged = [(s - least, m) for s, m in merged]
        serial += 1
        heapq.heappush(heap, (-(merged[0][0] - (merged[-1][0] if len(merged) == k else 0)), serial, merged))
    out = []
    for _, members in heap[0][2] if heap else []:
        flat, todo = [], [members]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo += x
            else:
                flat.append(x)
        out.append(flat)
    return out + [[] for _ in range(k - len(out))]


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """As few nearly equal windows as differencing finds without going over capacity."""
    total = sum(sizes)
    if max(sizes, default=0) > capacity:
        raise ValueError("a piece is longer than a window")
    k = max(1, -(-total // capacity))
    while True:
        found = differencing(sizes, k)
        largest = max(sum(sizes[i] for i in w) for w in found)
        if largest <= capacity:
            return [w for w in found if w]
        k += max(1, (largest - capacity) * k // (8 * capacity))


def packed(documents: Iterator[tuple[int | None, bytes]], capacity: int, piece: int, group: int, first: int) -> Iterator[tuple]:
    """documents: id, ids as 32-bit little-endian. Rows of SCHEMA; sequence ids count up from ``first``."""
    held: list[tuple] = []  # doc_id, start, length, crc, doc_tokens
    count = 0

    def flush():
        nonlocal first
        for window in windows([h[2] for h in held], capacity) if held else []:
            at = 0
            for i in sorted(window):
                yield (*held[i], first, at)
                at += held[i][2]
            first += 1
        held.clear()

    for doc_id, raw in documents:
        n, view = len(raw) // 4, memoryview(raw)
        full = n // capacity * capacity
        for at in range(0, full, capacity):
            yield (doc_id, at, capacity, zlib.crc32(view[4 * at : 4 * (at + capacity)]), n, first, 0)
            first += 1
        for at in range(full, n, piece):
            size = min(piece, n - at)
            held.append((doc_id, at, size, zlib.crc32(view[4 * at : 4 * (at + size)]), n))
        count += 1
        if count % group == 0:
            yield from flush()
    yield from flush()


def pack(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, piece: int = 256, group: int = 1024, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of its whole text and then ``end_id``, so null and empty texts are one id long; repeated
    rows are packed each. A sequence is one task's: its id holds the task's partition number.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        ids_of, end = library_ids(path).of, end_id.to_bytes(4, "little")

        def documents():
            for b in slices(batches):
                offsets, ids = batch_ids(b.column("text"), ids_of)
                for doc_id, begin, stop in zip(b.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    yield doc_id, ids[begin:stop].tobytes() + end

        rows: list[tuple] = []
        for row in packed(documents(), capacity, piece, group, TaskContext.get().partitionId() << 40):
            rows.append(row)
            if len(rows) >= 20_000:
                yield batch(rows)
                rows = []
        yield batch(rows)

    small_batches(df.sparkSession)
    return docs_of(df, id_col, text_col).mapInArrow(run, SCHEMA)


def batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)
