"""Near duplicates: MinHash signatures, a multi-index Hamming join, and confirmation on whole sets.

A signature holds ``CHUNKS * LENGTH`` symbols of 16 bits, from as many minima of hashes of a document's shingles. Two
signatures that differ in at most CHUNKS * 2 - 1 symbols agree, by the pigeonhole principle, in some chunk up to one
symbol. So the index has one key for each chunk and each symbol left out of it, and all pairs within that distance
meet. Of pairs beyond it most meet too: two sets with a Jaccard similarity of 0.75 agree in a chunk up to one symbol with a
probability of 0.75^5 + 5 * 0.75^4 * 0.25 = 0.633, and so in none of 20 with one of 0.367^20 = 2 in 10^9; more alike, less.

Documents with equal sets are one node from the start. Where keys bring nodes together, signatures with at most
``FAR`` differing symbols are joined into loose groups (two such sets differ in more of 100 symbols with a probability of 4 in
10^11). Then each loose group's texts meet, and whole sets of shingles decide which links are real. Nowhere are all
pairs of a group written: within a key and within a group, a search from node to node leaves a tree.

A key or a loose group of any size is dealt into parts of bounded size, and every two parts meet in a task of their own. So
tasks stay small, but a group's rows are read once for each of its parts. Links within a part are written once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Lately
from .common import docs_of, forget, releasing, small_batches, stored
from .components import components

WORDS, CHUNKS, LENGTH, FAR = 5, 20, 5, 55
MEMBERS = 500  # of a key, searched together
AT_ONCE = 1_000_000  # shingles that a task confirms together


class Shingles:
    """Sets of hashed word shingles: 64 bits each, in ascending order."""

    def __init__(self):
        self.known = Lately(xxhash.xxh64_intdigest, 150_000)

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII white space only
        known = self.known
        h = np.array([known[w] for w in words], np.uint64)
        if not len(h):
            return h
        n = max(1, len(h) - WORDS + 1)
        out = np.full(n, min(len(h), WORDS), np.uint64)
        for i in range(min(len(h), WORDS)):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
            out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return np.unique(out ^ (out >> np.uint64(32)))


class Signer:
    """Minima under CHUNKS * LENGTH hash functions: multiplications modulo 2^32, each of one of two 32-bit halves of a mixed shingle."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.factors = rng.integers(0, 1 << 31, (CHUNKS * LENGTH, 1), np.uint32) * np.uint32(2) + np.uint32(1)
        self.offsets = rng.integers(0, 1 << 32, (CHUNKS * LENGTH, 1), np.uint32)

    def sign(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(len(self.factors), (1 << 32) - 1, np.uint32)
        half = len(least) // 2
        for at in range(0, len(shingles), 2048):
            part = shingles[at : at + 2048]
            for own, x in ((slice(0, half), part.astype(np.uint32)), (slice(half, None), (part >> np.uint64(32)).astype(np.uint32))):
                h = x[None, :] * self.factors[own]
                h ^= self.offsets[own]
                np.minimum(least[own], h.min(1), out=least[own])
        mixed = least.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return (mixed >> np.uint64(48)).astype(np.int32)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest of the set (null if it is empty), sig."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        shingles, signer = Shingles(), Signer()
        for b in batches:
            n, digest, sig = [], [], []
            for text in b.column("text").to_pylist():
                s = shingles.of(text)
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sig.append(signer.sign(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.list_(pa.int32()))], ["doc_id", "n_shingles", "digest", "sig"])

    return docs.mapInArrow(releasing(run), "doc_id long, n_shingles long, digest binary, sig array<int>")


def keys(nodes: DataFrame) -> DataFrame:
    """node, key: for each chunk and each symbol of it left out, a hash of the others."""
    out = []
    for chunk in range(CHUNKS):
        for skip in range(LENGTH):
            out.append(F.xxhash64(F.lit(chunk * LENGTH + skip), *[F.col("sig")[chunk * LENGTH + i] for i in range(LENGTH) if i != skip]))
    return nodes.select("node", F.explode(F.array(*out)).alias("key"))


Near = Callable[[int, np.ndarray], np.ndarray]


def tree(rest: np.ndarray, near: Near) -> list[tuple[int, int]]:
    """Links that connect ``rest`` as ``near`` does, searched breadth first. near(i, others): which of others are linked to i."""
    out = []
    while len(rest) > 1:
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            hit = near(i, rest)
            if hit.any():
                found = rest[hit].tolist()
                out += [(i, j) for j in found]
                queue += found[::-1]
                rest = rest[~hit]
    return out


def joined(role: np.ndarray, search: Callable[[], Near]) -> list[tuple[int, int]]:
    """Links that connect the members of a cell: each of its two parts is searched by itself first, then both together, where one
    link is enough for two components. ``role`` is the part (0 or 1), and 2 more in the one cell that tells of a part's own links.
    """
    out, of = [], np.arange(len(role))
    sides = [np.flatnonzero(role & 1 == side) for side in (0, 1)]
    for own in sides:
        links = tree(own, search())
        for i, j in links:
            of[j] = of[i]
        out += [(i, j) for i, j in links if role[i] & 2 or role[j] & 2]
    if len(sides[0]) and len(sides[1]):
        near = search()
        both = tree(np.arange(len(role)), lambda i, rest: (of[rest] == of[i]) | near(i, rest))
        out += {(min(of[i], of[j]), max(of[i], of[j])): (i, j) for i, j in both if of[i] != of[j]}.values()
    return out


def runs_of(batches, key: str, work: Callable[[pa.Table], Iterator[tuple[int, int]]]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) that ``work`` finds in each run of equal keys of sorted rows."""
    held: list[pa.RecordBatch] = []

    def done(rows: pa.Table):
        k = rows.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        links = [x for a, b in zip(cuts, cuts[1:], strict=False) if b - a > 1 for x in work(rows.slice(a, b - a))]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["a", "b"])

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        first, last = held[0].column(key)[0].as_py(), b.column(key)[b.num_rows - 1].as_py()
        if first != last:
            rows = pa.Table.from_batches(held).combine_chunks()
            begin = int(np.flatnonzero(rows.column(key).to_numpy() != last)[-1]) + 1  # the last run may go on
            yield done(rows.slice(0, begin))
            held = rows.slice(begin).combine_chunks().to_batches()
    if held:
        yield done(pa.Table.from_batches(held).combine_chunks())


def told(role: np.ndarray) -> bool:
    """Whether a cell of two members tells of their link."""
    return bool((role[0] ^ role[1]) & 1 or role[0] & 2)


def by_signature(rows: pa.Table) -> list[tuple[int, int]]:
    nodes, role = rows.column("node").to_numpy(), rows.column("role").to_numpy()
    sig = rows.column("sig").combine_chunks().flatten().to_numpy().reshape(len(nodes), -1)
    if len(nodes) == 2:
        return [(nodes[0], nodes[1])] if told(role) and (sig[0] != sig[1]).sum() <= FAR else []
    sig = np.ascontiguousarray(sig.astype(np.uint16))
    return [(nodes[i], nodes[j]) for i, j in joined(role, lambda: lambda i, rest: (sig[rest] != sig[i]).sum(1) <= FAR)]


def cells(rows: DataFrame, name: str, parts: str) -> DataFrame:
    """``rows`` (node, name and ``parts`` parts a group) with the cells that each is in: pairs (p, q) of its group's parts, p its own or q.

    A node's role in a cell is 0 (in p) or 1 (in q), and 2 more where q follows its own part: links within a part are told of in that cell alone.
    """
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col(parts)).cast("int"))
    alone = F.array(F.struct(F.lit(0).alias("p"), F.lit(0).alias("q"), F.lit(2).alias("role")))
    others = F.filter(F.sequence(F.lit(0), F.col(parts) - 1), lambda q: q != F.col("part"))
    role = lambda q: (q < F.col("part")).cast("int") + F.when(q == F.pmod(F.col("part") + 1, F.col(parts)), 2).otherwise(0)
    pairs = F.transform(others, lambda q: F.struct(F.least(q, F.col("part")).alias("p"), F.greatest(q, F.col("part")).alias("q"), role(q).alias("role")))
    return dealt.select("node", F.explode(F.when(F.col(parts) <= 1, alone).otherwise(pairs)).alias("c"), name).select("node", "c.role", F.xxhash64(name, "c.p", "c.q").alias("cell"))


def loose_links(nodes: DataFrame, members: int = MEMBERS) -> DataFrame:
    """a, b: trees of nodes that share a key and have near signatures."""
    keyed = keys(nodes)
    met = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low"), F.max("node").alias("high"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).cast("string").alias("who")).where("n > 1")
    # the same members under many keys are looked at once
    met = stored(met.groupBy("n", "low", "high", "who").agg(F.min("key").alias("key")).select("key", "n", "low", "high"), "met")
    pairs = met.where("n = 2").select("key", F.explode(F.array("low", "high")).alias("node"), F.lit(1).alias("parts"))
    many = keyed.join(met.where("n > 2").select("key", F.ceil(F.col("n") / members).cast("int").alias("parts")), "key").select("key", "node", "parts")
    together = cells(pairs.unionByName(many), "key", "parts").join(nodes.select("node", "sig"), "node")

    def run(batches) -> Iterator[pa.RecordBatch]:
        return runs_of(batches, "cell", by_signature)

    found = together.repartition("cell").sortWithinPartitions("cell", "node").select("cell", "node", "role", "sig").mapInArrow(releasing(run), "a long, b long")
    found = stored(found, "loose")
    forget(met)
    return found


class Confirm:
    """Links between whole sets, for the rows of one group."""

    def __init__(self, percent: int):
        self.percent, self.shingles = percent, Shingles()

    def links(self, rows: pa.Table) -> list[tuple[int, int]]:
        nodes, role = rows.column("node").to_numpy(), rows.column("role").to_numpy()
        sets = [self.shingles.of(t) for t in rows.column("text").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        if len(nodes) == 2:
            if not told(role):
                return []
            both = len(np.intersect1d(*sets, assume_unique=True))
            return [(nodes[0], nodes[1])] if 100 * both >= self.percent * (int(sizes.sum()) - both) else []
        names, flat = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.cumsum(sizes) - sizes
        mark = np.zeros(len(names), np.int32)

        def search() -> Near:
            held: dict[str, np.ndarray] = {"rest": None}

            def near(i: int, rest: np.ndarray) -> np.ndarray:
                if held["rest"] is None or len(rest) < len(held["rest"]) // 2:
                    held["rest"] = rest
                    held["flat"] = np.concatenate([flat[starts[j] : starts[j] + sizes[j]] for j in rest])
                    held["starts"] = np.cumsum(sizes[rest]) - sizes[rest]
                own = flat[starts[i] : starts[i] + sizes[i]]
                mark[own] = 1
                both = np.add.reduceat(mark[held["flat"]], held["starts"])[np.searchsorted(held["rest"], rest)]
                mark[own] = 0
                return 100 * both >= self.percent * (sizes[i] + sizes[rest] - both)

            return near

        return [(nodes[i], nodes[j]) for i, j in joined(role, search)]


def confirmed_links(docs: DataFrame, groups: DataFrame, percent: int, at_once: int = AT_ONCE) -> DataFrame:
    """a, b: trees of the real links. groups: node, group, n_shingles of every node in a loose group.

    A group of more than ``at_once`` shingles is dealt into parts by node; each pair of parts is confirmed in a task of its own.
    """
    parts = groups.groupBy("group").agg(F.ceil(F.sum("n_shingles") / at_once).cast("int").alias("parts"))
    cell = cells(groups.join(parts, "group"), "group", "parts")
    rows = docs.join(cell.hint("shuffle_hash"), docs["doc_id"] == cell["node"]).select("cell", "node", "role", "text")

    def run(batches) -> Iterator[pa.RecordBatch]:
        return runs_of(batches, "cell", Confirm(percent).links)

    return rows.repartition("cell").sortWithinPartitions("cell", "node").mapInArrow(releasing(run), "a long, b long")


def near_duplicates(df: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", members: int = MEMBERS, at_once: int = AT_ONCE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, one row per row of ``df``.

    Documents are linked if 100 * |A and B| >= percent * |A or B| for their sets of 5-word shingles (fewer words: all of them as one;
    none: an empty set, linked with nothing). A component's id is its smallest doc_id. A row without an id is in no
    component (null) and kept. Rows that repeat an id are taken as one document, whatever their texts. ``members`` of a key
    and ``at_once`` shingles of a loose group are worked on together; they change no result. A link is missed with the
    probabilities above, which hold for ``percent`` of 75 and more; below 60 raise CHUNKS and FAR.
    """
    small_batches(df.sparkSession)
    docs = docs_of(df, id_col, text_col)
    signed = stored(signatures(docs), "signatures")
    best = signed.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "sig")).alias("x"))
    nodes = stored(best.select("digest", F.col("x.doc_id").alias("node"), F.col("x.n_shingles").alias("n_shingles"), F.col("x.sig").alias("sig")), "nodes")
    found = loose_links(nodes, members)
    loose = components(found)
    groups = stored(loose.join(nodes.select("node", "n_shingles"), "node").select("node", F.col("component").alias("group"), "n_shingles"), "groups")
    real = components(confirmed_links(docs, groups, percent, at_once))
    forget(found, loose, groups)
    named = nodes.select("digest", "node").join(real, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    return signed.select("doc_id", "n_shingles", "digest").join(named, "digest", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"), F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept")
    )


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that are the smallest id of their component, with all their columns."""
    kept = near_duplicates(docs, **how).where("kept and doc_id is not null").select(F.col("doc_id").alias("__id")).distinct()
    id_col = docs[how.get("id_col", "doc_id")].cast("long")
    found = docs.join(kept.hint("shuffle_hash"), id_col == kept["__id"], "left_semi")
    return found.unionByName(docs.where(id_col.isNull()))
