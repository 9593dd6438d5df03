"""Language identification by cross-parsing entropy.

For each language, a suffix automaton of labelled text holds all that text's substrings. A document is parsed with it
from left to right into the longest phrases that the labelled text holds; a text in that language needs few. The
phrases, times the log of the labelled text's length, per letter, estimate the cross entropy; the least wins.

The automata of all languages are one table of moves, in which a missing move leads on from the start and
counts a phrase, so that parsing is one lookup per letter, done for all documents of a batch and all languages at once.
Long texts are cut into blocks that are parsed side by side, each from the start; then each block is read again from the
state in which the block before really ended, until both parses are in one state, from where on they are the same. So counts
are those of one parse of the whole text.

Frequent letters are symbols of their own; a rarer one is spelled by the bytes of its UTF-8 form, so no two letters are taken for one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import docs_of, fold, small_batches

BLOCK = 2048  # symbols parsed side by side; changes no result
UNKNOWN = "und"
GAP, OTHER = 0, 1  # symbols of what is between words, and of letters and bytes that no labelled text holds


class Automaton:
    """The suffix automaton of a sequence of symbols: states' moves as dicts."""

    def __init__(self, symbols):
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols:
            new = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = link[p]
                    link[q] = link[new] = clone
            last = new


class Parser:
    """Cross-parsing with the automata of several languages at once."""

    def __init__(self, languages: tuple[str, ...], texts: tuple[str, ...], letters: int = 200, block: int = BLOCK):
        count: dict[str, int] = {}
        for text in texts:
            for c in text.lower():
                if c.isalpha():
                    count[c] = count.get(c, 0) + 1
        alphabet = sorted(sorted(count, key=lambda c: (-count[c], c))[:letters])
        self.block = block
        self.symbol = np.zeros(0x110000, np.uint16)
        every = np.frombuffer("".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)])).encode("utf-32-le"), np.uint32)
        self.symbol[every] = np.fromiter((chr(i).isalpha() for i in every), np.uint8, len(every)) * OTHER
        for i, c in enumerate(alphabet):
            self.symbol[ord(c)] = OTHER + 1 + i
        spelled = sorted({b for c in count.keys() - set(alphabet) for b in c.encode()})
        self.bytes = np.full(256, OTHER, np.uint16)
        for i, b in enumerate(spelled):
            self.bytes[b] = OTHER + 1 + len(alphabet) + i
        self.languages, self.width = languages, len(alphabet) + len(spelled) + 2
        tables, self.starts, self.bits, offset = [], [], [], 0
        for text in texts:
            symbols = self.symbols(text)
            moves = Automaton(symbols.tolist()).next
            begin = np.full(self.width, offset * self.width * 2 + 1, np.int64)  # after a letter that begins no phrase: the start
            for c, s in moves[0].items():
                begin[c] = (offset + s) * self.width * 2 + 1
            table = np.repeat(begin[None, :], len(moves), 0)
            for i, row in enumerate(moves):
                for c, s in row.items():
                    table[i, c] = (offset + s) * self.width * 2
            table[0] = begin  # the start is where a text begins, or where a letter was that begins no phrase
            tables.append(table.ravel())
            self.starts.append(offset * self.width)
            self.bits.append(np.log2(max(2, len(symbols))))
            offset += len(moves)
        # a move holds twice the index of the next state's row, plus 1 if a phrase ends before the letter
        self.table = np.concatenate(tables).astype(np.int32 if offset * self.width * 2 < 2**31 else np.int64)

    def symbols(self, text: str) -> np.ndarray:
        """Letters in lower case as numbers; each run of other characters is one gap."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        s = self.symbol[points]
        rare = s == OTHER
        if rare.any():
            size = np.where(rare, 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000), 1)
            s, rare, letters = np.repeat(s, size), np.repeat(rare, size), points[rare]
            s[rare] = self.bytes[np.frombuffer(letters.tobytes().decode("utf-32-le").encode(), np.uint8)]
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] != GAP) | (s[:-1] != GAP)
        return s[keep]

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text (row) for each language (column)."""
        blocks = [[s[at : at + self.block] for at in range(0, len(s), self.block)] for s in texts]
        lanes = [x for own in blocks for x in own]
        total = np.zeros((len(texts), len(self.languages)), np.int64)
        if not lanes:
            return total
        order = np.argsort([-len(x) for x in lanes], kind="stable")
        sizes = np.array([len(lanes[i]) for i in order])
        grid = np.zeros((int(sizes[0]), len(lanes)), self.table.dtype)
        for column, i in enumerate(order):
            grid[: len(lanes[i]), column] = lanes[i]
        live = np.searchsorted(-sizes, -np.arange(int(sizes[0])), "left")  # lanes longer than each step
        begin = np.array(self.starts, self.table.dtype)[:, None]
        state, count = np.repeat(begin, len(lanes), 1), np.zeros((len(self.languages), len(lanes)), np.int64)
        for step in range(int(sizes[0])):
            k = live[step]
            move = self.table.take(state[:, :k] + grid[step, :k])
            count[:, :k] += move & 1
            state[:, :k] = move >> 1
        where = np.empty(len(lanes), np.int64)
        where[order] = np.arange(len(lanes))
        # blocks after a text's first one, all texts' second blocks at once, then their third ones
        first = np.cumsum([0, *map(len, blocks)])
        for turn in range(1, max(map(len, blocks))):
            own = np.array([where[first[i] + turn] for i, b in enumerate(blocks) if len(b) > turn])
            real, known = state[:, [where[first[i] + turn - 1] for i, b in enumerate(blocks) if len(b) > turn]], np.repeat(begin, len(own), 1)
            more, size = np.zeros(real.shape, np.int64), np.array([len(b[turn]) for b in blocks if len(b) > turn])
            for step in range(int(size.max())):
                at = np.flatnonzero((real != known).any(0) & (size > step))
                if not len(at):
                    break
                one, two = (self.table.take(x[:, at] + grid[step, own[at]]) for x in (real, known))
                more[:, at] += (one & 1) - (two & 1)
                real[:, at], known[:, at] = one >> 1, two >> 1
            count[:, own] += more
            state[:, own] = np.where(real != known, real, state[:, own])
        np.add.at(total, np.repeat(np.arange(len(texts)), list(map(len, blocks))), count[:, where].T)
        return total

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        symbols = [self.symbols(t or "") for t in texts]
        letters = np.array([int(np.count_nonzero(s)) for s in symbols])
        bits = self.phrases(symbols) * np.array(self.bits) / np.maximum(letters, 1)[:, None]
        best = bits.argmin(1)
        # how sure: each language's share if a text were as unlikely as its bits say, with at most 100 letters' weight
        share = np.exp2(-(bits - bits.min(1, keepdims=True)) * np.minimum(letters, 100)[:, None] * 0.1).sum(1)
        return [(self.languages[b], float(1 / s)) if n else (UNKNOWN, 0.0) for b, s, n in zip(best, share, letters, strict=True)]


@lru_cache(2)
def parser(languages: tuple[str, ...], texts: tuple[str, ...]) -> Parser:
    """Built once per worker from the labelled text."""
    return Parser(languages, texts)


def learn(df: DataFrame, lang_col: str = "lang", train: Column | None = None, chars: int = 40_000, total: int = 400_000, least: int = 200) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """(languages, labelled text of each), from a bounded sample: for every language documents with the smallest hashes of their ids, of a longer one
    its first ``chars`` characters, up to ``chars`` characters together; ``total`` bounds all languages' text, of which each has ``least`` at least."""
    usable = df.where(F.col(lang_col).isNotNull() & F.col("text").isNotNull())
    usable = (usable if train is None else usable.where(train)).select(F.col(lang_col).alias("lang"), "doc_id", "text").where(F.col("text").rlike(r"\p{L}"))
    at = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sizes = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.least(F.length("text"), F.lit(chars))).alias("c")).collect()
    if not sizes:
        return (), ()
    most = min(chars, max(least, total // len(sizes)))
    # four times the text that is needed, and 20 documents or more, so that no language comes out with none
    limit = F.element_at(F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(max(4 * most / r["c"], 20 / r["n"])))]), F.col("lang"))
    got: dict[str, list] = {r["lang"]: [] for r in sizes}
    for r in usable.where(at < limit).select("lang", F.substring("text", 1, most).alias("text"), at.alias("at"), "doc_id").orderBy("at", "doc_id").collect():
        got[r["lang"]].append(r["text"])
    texts = {lang: " ".join(parts)[:most] for lang, parts in sorted(got.items()) if parts}
    return tuple(texts), tuple(texts.values())


def identify(df: DataFrame, lang_col: str = "lang", folds: int = 5, held: int = 0, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """doc_id, held_out, lang_pred, score (0 to 1), one row per row of ``df``.

    Learns from the labels of all folds but ``held``. A null text, or one without a letter, is ``und`` with score 0, as
    is every text where nothing is labelled. Ties go to the first language by name. Rows without an id are predicted as all
    others (their fold is that of the empty text), and so is each of the rows that repeat one.
    """
    spark = df.sparkSession
    docs = df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text"), df[lang_col].alias("lang"))
    languages, texts = learn(docs, train=fold(F.col("doc_id"), folds) != held, **how)

    def run(batches) -> Iterator[pa.RecordBatch]:
        p = parser(languages, texts) if languages else None
        for b in batches:
            found = p.predict(b.column("text").to_pylist()) if p else [(UNKNOWN, 0.0)] * b.num_rows
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    small_batches(spark)
    out = docs_of(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", (fold(F.col("doc_id"), folds) == held).alias("held_out"), "lang_pred", "score")
