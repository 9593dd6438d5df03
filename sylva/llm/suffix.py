"""Removing repeated passages: every byte covered by a string of ``width`` bytes that also starts earlier.

Anchors. Of each window's strings of ``GRAM`` bytes the one with the least hash is its anchor, so that equal windows have equal
anchors at equal places. A task keeps, of a block of texts, the first anchor with each neighbourhood (all windows that can
hold it) and knows at once that the others repeat it; the first ones are exchanged by hash. An anchor whose whole
neighbourhood occurred earlier covers it; neighbourhoods are told apart by 128-bit digests. Where those of one anchor differ, the
first of each kind goes on to the suffix array.

Contexts. Two equal windows around an anchor are equal for half the way on one of its sides at least. So each
anchor gives two contexts, keyed by a digest of its bytes and the half on the right, or on the left; a window is found under one of the
two. Where too many contexts share a key, each is halved again: the half on either side of what is still free. So groups get small, or
their members' windows are wholly equal, and no group is ever held as a whole.

Suffix array. What the contexts of many groups have beyond their keys, to the right and (mirrored) to the left, becomes one text over the
alphabet of ``BLOCK`` bytes in their order. Its suffixes are sorted by linear grouping: groups of suffixes
by their Lyndon prefixes are worked off in descending order, each marking, through previous-smaller pointers, the suffixes
whose prefix it prolongs; then each group's order is emitted from the order of what follows. Longest common
prefixes of neighbours in that order, symbols compared and then the bytes of the first that differ, tell which windows are equal: a
window reaching j bytes to the right of the anchor is fixed by a run of right contexts that share j bytes and a run of left
contexts that share the rest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bpe import slices
from .common import forget, releasing, small_batches, stored

GRAM = 32
BASE = 0x9E3779B97F4A7C15
PIECE = 1 << 20  # bytes of a text that are hashed at once
TEXTS = 8 << 20  # bytes of texts whose anchors are compared in their task
AT_ONCE = 8192  # contexts that are sorted together
BLOCK = 2  # bytes of a symbol


def suffix_array(text: list[int]) -> list[int]:
    """Start places of the text's suffixes in ascending order; a suffix that is a prefix of another comes first."""
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    place = [0] * n  # where in `order` a suffix stands
    group = [0] * n  # the first place of its group
    end: dict[int, int] = {}  # one past the last place of the group that begins at a place
    before = [-1] * n  # the previous suffix in a smaller group
    begin = 0
    for at, i in enumerate(order):
        if text[i] != text[order[begin]]:
            end[begin] = at
            begin = at
        place[i] = at
        group[i] = begin
    if n:
        end[begin] = n
    # first: groups in descending order, each splitting the groups of the suffixes before its members
    top = n
    while top:
        low = group[order[top - 1]]
        children: dict[int, int] = {}
        for i in sorted(order[low:top]) if top - low > 1 else order[low:top]:
            p = i - 1
            while p >= 0 and group[p] >= low:
                p = before[p]
            before[i] = p
            if p >= 0:
                children[p] = children.get(p, 0) + 1
        if children:
            levels: dict[int, list[int]] = {}
            for p, k in children.items():
                levels.setdefault(k, []).append(p)
            for k in sorted(levels, reverse=True):  # who is prolonged more often is greater
                moved = []
                for p in levels[k]:
                    old = group[p]
                    last = end[old] - 1
                    other, at = order[last], place[p]
                    order[at], order[last] = other, p
                    place[other], place[p] = at, last
                    end[old] = last
                    moved.append((p, old))
                new: dict[int, int] = {}
                for p, old in moved:
                    start = end[old] if old not in new else new[old]
                    new[old] = start
                    group[p] = start
                size: dict[int, int] = {}
                for _, old in moved:
                    size[old] = size.get(old, 0) + 1
                for old, start in new.items():
                    end[start] = start + size[old]
                    if start != old:
                        end[old] = start
        top = low
    # second: from the smallest on, every suffix puts what stands before it in order
    free = {}
    for g in group:
        free[g] = g
    done = bytearray(n)

    def emit(p: int) -> None:
        while p >= 0 and not done[p]:
            g = group[p]
            order[free[g]] = p
            free[g] += 1
            done[p] = 1
            p = before[p]

    emit(n - 1)
    for at in range(n):
        emit(order[at] - 1)
    return order


# --- anchors


def slid(x: np.ndarray, width: int, f) -> np.ndarray:
    """f over every window of ``width`` values."""
    size = 1
    while size * 2 <= width:
        x = f(x[:-size], x[size:])
        size *= 2
    return f(x[: len(x) - (width - size)], x[width - size :]) if size < width else x


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Hasher:
    """Polynomial hashes modulo 2^64 of any stretch of a text."""

    def __init__(self):
        self.grow(1 << 16)

    def grow(self, n: int) -> None:
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            powers = np.full(n, base, np.uint64)
            powers[0] = 1
            setattr(self, name, np.cumprod(powers, dtype=np.uint64))

    def anchors(self, raw: bytes, width: int, size: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
        """(hash, place) of each anchor of a text. A long text is read in overlapping pieces."""
        reach, found = width - GRAM, []
        for at in range(0, max(1, len(raw) - width + 1), size):
            low, high = max(0, at - reach), min(len(raw), at + size + width - 1 + reach)
            found.append(self.piece(raw, low, high, at - low, min(len(raw), at + size + width - 1) - low, width))
        if len(found) == 1:
            return found[0]
        h, pos = (np.concatenate(x) for x in zip(*found, strict=True))
        pos, once = np.unique(pos, return_index=True)  # pieces overlap
        return h[once], pos

    def piece(self, raw: bytes, low: int, high: int, first: int, last: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Anchors of the windows between ``first`` and ``last``, both counted from ``low``."""
        a = np.frombuffer(raw, np.uint8)[low:high].astype(np.uint64) + np.uint64(1)
        if len(a) >= len(self.up):
            self.grow(2 * len(a))
        sums = np.zeros(len(a) + 1, np.uint64)
        np.cumsum(a * self.up[: len(a)], out=sums[1:])
        h = mixed((sums[GRAM:] - sums[:-GRAM]) * self.down[: len(a) - GRAM + 1])[first : last - GRAM + 1]
        reach = width - GRAM
        pad = np.zeros(reach, np.uint64)
        p = np.flatnonzero(slid(np.concatenate([pad, slid(h, reach + 1, np.minimum), pad]), reach + 1, np.maximum) == h)
        return h[p].view(np.int64), p + first + low


def neighbourhoods(raw: bytes, pos: np.ndarray, width: int) -> bytes:
    """128-bit digests of all that the windows around each anchor can hold, with how much there is on its left."""
    reach, digest = width - GRAM, xxhash.xxh3_128_digest
    return b"".join([digest(raw[max(0, p - reach) : p + width], min(p, reach)) for p in pos.tolist()])


def anchors(docs: DataFrame, width: int, piece: int = PIECE, texts: int = TEXTS) -> DataFrame:
    """h, n1, n2 (halves of the neighbourhood's digest), did, pos; repeats: whether an anchor of the same block of texts with this neighbourhood comes earlier."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in slices(batches, texts):
            got, ids, digests = [], [], []
            for did, text in zip(b.column("did").to_pylist(), b.column("text").to_pylist(), strict=True):
                raw = text.encode()
                if len(raw) >= width:
                    got.append(hasher.anchors(raw, width, piece))
                    ids.append(np.full(len(got[-1][0]), did))
                    digests.append(neighbourhoods(raw, got[-1][1], width))
            if not got:
                continue
            h, pos = (np.concatenate(x) for x in zip(*got, strict=True))
            did, near = np.concatenate(ids), np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            order = np.lexsort((pos, did, near[:, 1], near[:, 0]))
            h, pos, did, near = h[order], pos[order], did[order], near[order]
            again = np.zeros(len(h), bool)
            again[1:] = (near[1:] == near[:-1]).all(1) & (h[1:] == h[:-1])
            # one place of one document, read twice (rows that repeat an id), is no repetition
            twice = np.zeros(len(h), bool)
            twice[1:] = again[1:] & (did[1:] == did[:-1]) & (pos[1:] == pos[:-1])
            some = ~twice
            yield pa.RecordBatch.from_arrays([pa.array(h[some]), pa.array(near[some, 0]), pa.array(near[some, 1]), pa.array(did[some]), pa.array(pos[some].astype(np.int32)), pa.array(again[some])], ["h", "n1", "n2", "did", "pos", "repeats"])

    return docs.mapInArrow(releasing(run), "h long, n1 long, n2 long, did long, pos int, repeats boolean")


# --- contexts of anchors whose neighbourhoods differ


def common_prefixes(groups: np.ndarray, sides: list[np.ndarray], block: int = BLOCK) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each side (rows of bytes plus 1, 0 where a text has ended): each row's place among the side's distinct contexts in the order of the
    suffix array, and, by place, how many bytes a context shares with the one before; -1 where another group begins.

    One text holds all distinct contexts: a number of group and side, symbols of ``block`` bytes, and an end that is smaller than all.
    """
    length = sides[0].shape[1]
    per = -(-length // block)
    padded = [np.pad(s, ((0, 0), (0, per * block - length))) for s in sides]
    pieces = [np.ascontiguousarray(p).view(f"V{block}" if block not in (1, 2) else (">u2" if block == 2 else "u1")).reshape(len(p), per) for p in padded]
    names, numbers = np.unique(np.concatenate([p.ravel() for p in pieces]), return_inverse=True)
    numbers = numbers.reshape(len(sides), -1, per)
    base, text, begins, firsts, which = len(names) + 1, [], [], [], []
    for side, rows in enumerate(numbers):
        keyed = np.ascontiguousarray(np.concatenate([groups[:, None], rows], 1))
        _, first, own = np.unique(keyed.view(f"V{keyed.shape[1] * keyed.itemsize}").ravel(), return_index=True, return_inverse=True)
        whole = np.empty((len(first), per + 2), np.int64)
        whole[:, 0] = base + groups[first] * len(sides) + side
        whole[:, 1:-1] = rows[first] + 1
        whole[:, -1] = 0
        begins.append(len(text) + np.arange(len(first)) * (per + 2))
        text += whole.ravel().tolist()
        firsts.append(first)
        which.append(own)
    rank = np.empty(len(text), np.int64)
    rank[suffix_array(text)] = np.arange(len(text))
    out = []
    for side, begin, first, own in zip(sides, begins, firsts, which, strict=True):
        order = np.argsort(rank[begin])  # distinct contexts as the suffix array has them
        rows = first[order]
        common = np.full(len(rows), -1)
        if len(rows) > 1:
            same = side[rows[1:]] == side[rows[:-1]]
            common[1:] = np.where(same.all(1), length, same.argmin(1))
            common[1:][groups[rows[1:]] != groups[rows[:-1]]] = -1
        at = np.empty(len(begin), np.int64)
        at[order] = np.arange(len(begin))
        out.append((at[own], common))
    return out


def repeated_windows(groups: np.ndarray, left: np.ndarray, right: np.ndarray, lefts: np.ndarray, rights: np.ndarray) -> np.ndarray:
    """Whether a window occurs in an earlier row of its group: rows by i, the number of bytes that it takes of the right side.

    A group's rows share all but their sides. left, right: rows of free bytes (plus 1, 0 where the text has ended), outwards from what is
    shared; a window takes i of the one and all but i of the other. lefts, rights: how many each row has.
    """
    free = left.shape[1]
    (left_at, left_common), (right_at, right_common) = common_prefixes(groups, [left, right])
    out = np.zeros((len(groups), free + 1), bool)
    for i in range(free + 1):
        valid = np.flatnonzero((lefts >= free - i) & (rights >= i))
        key = (np.cumsum(left_common < free - i)[left_at[valid]] << 32) | np.cumsum(right_common < i)[right_at[valid]]
        _, first = np.unique(key, return_index=True)
        again = np.ones(len(valid), bool)
        again[first] = False
        out[valid, i] = again
    return out


CONTEXT = "key binary, did long, pos int, r int, l int, around binary, gap int"  # r, l: shared bytes on the right and left of the anchor; gap: of its reach before it, missing


def halves(around: bytes, gap: int, r: int, l: int, reach: int) -> Iterator[tuple[int, int, bytes]]:  # noqa: E741
    """(r, l, key) of the two contexts whose windows are all those of a context that shares r and l bytes."""
    at, half = reach - gap, (reach - r - l + 1) // 2
    for more_r, more_l in ((r + half, l), (r, reach - r - half + 1)) if half else ():
        a, b = at - more_l, at + GRAM + more_r
        if a >= 0 and b <= len(around):
            yield more_r, more_l, xxhash.xxh3_128_digest(around[a:b], more_r * reach + more_l)


def contexts_of(joined: DataFrame, width: int) -> DataFrame:
    """CONTEXT, two rows for every anchor listed with a text."""
    reach = width - GRAM

    def run(batches) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            for did, text, found in zip(b.column("did").to_pylist(), b.column("text").to_pylist(), b.column("found").to_pylist(), strict=True):
                raw = text.encode()
                for p in found:
                    around, gap = raw[max(0, p - reach) : p + width], max(0, reach - p)
                    rows += [(key, did, p, r, l, around, gap) for r, l, key in halves(around, gap, 0, 0, reach)]
                    if len(rows) >= 20_000:
                        yield contexts_batch(rows)
                        rows = []
        yield contexts_batch(rows)

    return joined.mapInArrow(releasing(run), CONTEXT)


def contexts_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
    kinds = [pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in CONTEXT.split(", ")])


def halved(contexts: DataFrame, width: int) -> DataFrame:
    """Contexts of groups that are too large, each as the two that share more."""
    reach = width - GRAM

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("did", "pos", "r", "l", "around", "gap")]
            yield contexts_batch([(key, did, p, r2, l2, around, gap) for did, p, r, l, around, gap in zip(*columns, strict=True) for r2, l2, key in halves(around, gap, r, l, reach)])

    return contexts.mapInArrow(releasing(run), CONTEXT)


def resolved(contexts: DataFrame, width: int, at_once: int = AT_ONCE) -> DataFrame:
    """did, span (start << 32 | end) of repeated windows. Rows come sorted by key, did, pos; groups have at most ``at_once`` rows, or share whole windows."""
    reach = width - GRAM

    def spans(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        r = rows.column("r").to_numpy()
        l = rows.column("l").to_numpy()  # noqa: E741
        for free in np.unique(reach - r - l).tolist():
            yield of_kind(rows.filter(pa.array(reach - r - l == free)), free)

    def of_kind(rows: pa.Table, free: int) -> pa.RecordBatch:
        n = rows.num_rows
        r, l, gap, pos, did = (rows.column(c).to_numpy().astype(np.int64) for c in ("r", "l", "gap", "pos", "did"))  # noqa: E741
        around = np.zeros((n, width + reach), np.uint8)  # bytes plus 1, 0 where there is no text; 255 has no successor, but is in no UTF-8
        for i, (piece, at) in enumerate(zip(rows.column("around").to_pylist(), gap.tolist(), strict=True)):
            around[i, at : at + len(piece)] = np.frombuffer(piece, np.uint8) + 1
        places = np.arange(free)
        right = np.take_along_axis(around, (reach + GRAM + r)[:, None] + places, 1)
        left = np.take_along_axis(around, (reach - 1 - l)[:, None] - places, 1)
        keys = rows.column("key").to_numpy(zero_copy_only=False)
        groups = np.cumsum(np.r_[0, keys[1:] != keys[:-1]])
        again = np.zeros((n, free + 3), np.int8)
        again[:, 1:-1] = repeated_windows(groups, left, right, (left > 0).sum(1), (right > 0).sum(1))
        step = np.diff(again, axis=1)
        who, first = np.nonzero(step == 1)
        _, last = np.nonzero(step == -1)
        start = pos[who] - reach + r[who]  # of the window that takes nothing more on the right
        return pa.RecordBatch.from_arrays([pa.array(did[who]), pa.array(((start + first) << 32) | (start + last - 1 + width))], ["did", "span"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n, last = 0, None  # rows held, all of groups that are whole but for the last one
        before = None  # the last row of a group that shares whole windows
        for b in batches:
            whole = b.column("r").to_numpy() + b.column("l").to_numpy() == reach
            if whole.any():
                same = b.filter(pa.array(whole))
                keys, did, pos, r = (same.column(c).to_pylist() for c in ("key", "did", "pos", "r"))
                out = []
                for k, d, p, x in zip(keys, did, pos, r, strict=True):
                    if before is not None and before[0] == k and before[1:] != (d, p):
                        out.append((d, (p - reach + x) << 32 | (p - reach + x + width)))
                    before = (k, d, p)
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["did", "span"])
            b = b.filter(pa.array(~whole))
            if not b.num_rows:
                continue
            held.append(b)
            n += b.num_rows
            if n >= at_once:
                rows = pa.Table.from_batches(held).combine_chunks()
                keys = rows.column("key").to_numpy(zero_copy_only=False)
                last = keys[-1]
                begin = n - int(np.argmax(keys[::-1] != last)) if (keys != last).any() else 0  # where the last group begins; it may go on
                if begin:
                    yield from spans(more_than_one(rows.slice(0, begin)))
                rest = rows.slice(begin).combine_chunks()
                held, n = rest.to_batches(), rest.num_rows
        if n:
            yield from spans(more_than_one(pa.Table.from_batches(held).combine_chunks()))

    return contexts.mapInArrow(releasing(run), "did long, span long")


def more_than_one(rows: pa.Table) -> pa.Table:
    """The rows, in order of their keys, without those that are alone with theirs, or that are there twice (documents that repeat an id)."""
    did, pos = rows.column("did").to_numpy(), rows.column("pos").to_numpy()
    twice = np.r_[False, (did[1:] == did[:-1]) & (pos[1:] == pos[:-1])]
    for i in np.flatnonzero(twice).tolist():
        twice[i] = all(rows.column(c)[i] == rows.column(c)[i - 1] for c in ("key", "around"))
    if twice.any():
        rows = rows.filter(pa.array(~twice)).combine_chunks()
    keys = rows.column("key").to_numpy(zero_copy_only=False)
    like_last = np.r_[False, keys[1:] == keys[:-1]]
    return rows.filter(pa.array(like_last | np.r_[like_last[1:], False])).combine_chunks()


def repeated_contexts(contexts: DataFrame, width: int, at_once: int) -> tuple[DataFrame, list[DataFrame]]:
    """did, span of repeated windows, and the tables to delete afterwards. Groups of more than ``at_once`` are halved until none is left, or only whole windows."""
    found, tables = [], []
    while True:
        contexts = stored(contexts, "contexts")
        tables.append(contexts)
        free = F.col("r") + F.col("l") < width - GRAM
        large = contexts.where(free).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > at_once).select("key", F.lit(True).alias("large"))
        large = stored(large, "large")
        tables.append(large)
        if large.isEmpty():
            found.append(contexts)
            break
        both = contexts.join(large, "key", "left")
        found.append(both.where("large is null").drop("large"))
        contexts = halved(both.where("large").drop("large"), width)
    out = [resolved(c.repartition("key").sortWithinPartitions("key", "did", "pos", "around"), width, at_once) for c in found]
    spans = out[0]
    for more in out[1:]:
        spans = spans.unionByName(more)
    return spans, tables


# --- the operator


def kept_bytes(raw: bytes, spans: list[int] | None) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of a text, and the maximal removed runs."""
    runs: list[tuple[int, int]] = []
    for span in sorted(spans or ()):
        a, b = max(0, span >> 32), min(len(raw), span & 0xFFFFFFFF)
        if runs and a <= runs[-1][1]:
            if b > runs[-1][1]:
                runs[-1] = (runs[-1][0], b)
        elif a < b:
            runs.append((a, b))
    left, at = [], 0
    for a, b in runs:
        left.append(raw[at:a])
        at = b
    left.append(raw[at:])
    return b"".join(left), runs


def key_of(id_col: Column) -> Column:
    """Ids that are null come last in the order of documents."""
    return F.coalesce(id_col.cast("long"), F.lit((1 << 63) - 1))


def repeated_spans(docs: DataFrame, width: int, piece: int = PIECE, texts: int = TEXTS, at_once: int = AT_ONCE) -> DataFrame:
    """did, spans: all stretches of each document (did, text) that occurred earlier; documents without any are missing."""
    reach = width - GRAM
    order = Window.partitionBy("h").orderBy("n1", "n2", "did", "pos")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = F.struct("n1", "n2")
    every_anchor = stored(anchors(docs, width, piece, texts), "all-anchors")
    rows = (
        every_anchor.where("not repeats").drop("repeats")
        .select("*", F.count(F.lit(1)).over(every).alias("n"), (F.min(near).over(every) != F.max(near).over(every)).alias("differ"), F.lag("n1").over(order).alias("p0"), F.lag("n2").over(order).alias("p1"), F.lag("did").over(order).alias("p2"), F.lag("pos").over(order).alias("p3"))
        .where("n > 1")
    )
    known = F.col("p0").eqNullSafe(F.col("n1")) & F.col("p1").eqNullSafe(F.col("n2"))
    twice = known & F.col("p2").eqNullSafe(F.col("did")) & F.col("p3").eqNullSafe(F.col("pos"))  # one place, read twice
    found = stored(rows.where(~twice & (known | F.col("differ"))).select("did", "pos", known.alias("known")), "anchors")
    alike = found.where("known").select("did", "pos").unionByName(every_anchor.where("repeats").select("did", "pos"))
    whole = alike.select("did", (F.shiftleft(F.greatest(F.col("pos").cast("long") - reach, F.lit(0)), 32).bitwiseOR(F.col("pos").cast("long") + width)).alias("span"))
    lists = found.where("not known").groupBy("did").agg(F.collect_list("pos").alias("found"))
    partial, tables = repeated_contexts(contexts_of(docs.join(lists.hint("shuffle_hash"), "did").select("did", "text", "found"), width), width, at_once)
    out = stored(whole.unionByName(partial).groupBy("did").agg(F.collect_list("span").alias("spans")), "spans")
    forget(found, every_anchor, *tables)
    return out


def remove_repeats(df: DataFrame, width: int = 100, id_col: str = "doc_id", text_col: str = "text", **sizes) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary: the bytes left), spans (array of start, end), one row per row of ``df``.

    Texts count as UTF-8; null texts are empty. Matches never cross documents; ids order documents, null ids last. A text
    shorter than ``width`` keeps all. Rows that repeat an id count as one document if their texts are equal; texts that differ
    under one id are judged together. ``sizes`` (piece, texts, at_once) bound what a task holds; they change no result.
    """
    if width < GRAM + 4 or (width - GRAM) % 2:
        raise ValueError("width must be even and at least 36")
    small_batches(df.sparkSession)
    docs = df.select(key_of(df[id_col]).alias("did"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))
    spans = repeated_spans(docs, width, **sizes)

    def run(batches) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.list_(pa.int64()))]
        for b in batches:
            out = []
            for did, text, found in zip(b.column("did").to_pylist(), b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                raw = text.encode()
                kept, runs = kept_bytes(raw, found)
                out.append((None if did == (1 << 63) - 1 else did, len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept, [list(r) for r in runs]))
            columns = zip(*out, strict=True) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"])

    return docs.join(spans.hint("shuffle_hash"), "did", "left").select("did", "text", "spans").mapInArrow(releasing(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<array<long>>")


def without_repeats(docs: DataFrame, width: int = 100) -> DataFrame:
    """``docs`` with repeated passages cut from ``text``, and ``n_chars``, if it is a column, counted anew. All rows and other columns stay.

    Where a cut splits a character, the rest of it goes too. A null text stays null.
    """
    small_batches(docs.sparkSession)
    key = key_of(docs["doc_id"])
    spans = repeated_spans(docs.select(key.alias("did"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text")), width)
    names = docs.columns
    taken = {n.lower() for n in names}
    of, found_in = (next(n for n in (f"{x}{'_' * i}" for i in range(len(names) + 1)) if n.lower() not in taken) for x in ("did", "spans"))
    renamed = spans.select(F.col("did").alias(of), F.col("spans").alias(found_in))
    joined = docs.join(renamed.hint("shuffle_hash"), key == F.col(of), "left").select(*[docs[c] for c in names], F.col(found_in))
    text_at, chars_at = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for text, found in zip(b.column(text_at).to_pylist(), b.column(len(names)).to_pylist(), strict=True):
                texts.append(kept_bytes(text.encode(), found)[0].decode("utf-8", "ignore") if found and text else text)
            columns = list(b.columns[: len(names)])
            columns[text_at] = pa.array(texts, columns[text_at].type)
            if chars_at is not None:
                columns[chars_at] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(columns[chars_at].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(releasing(run), docs.schema)
