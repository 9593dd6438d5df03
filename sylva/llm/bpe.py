"""BPE encoding by backtracking over Aho-Corasick matches, and decoding by an offset table.

Of all ways to cut a word into tokens, the merges choose the one in which every two neighbours are compatible:
the merges, run on the two neighbours' text alone, give these two tokens again. So the encoder takes the
longest token at each place, checks it against the token before, and steps back where nothing fits. Each token
is tried once at each place, so the time is linear.

The words are those of the vocabulary's own normaliser (NFC, white space, lower case) and splitting pattern.
As no word holds white space, texts are cut there first: Arrow cuts a batch and numbers its distinct pieces, which are
encoded once each, with a table of bounded size for those met in other batches, and numpy puts the texts together again.
"""

from __future__ import annotations

import hashlib
import json
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from ahocorasick import Automaton
from pyspark.sql import DataFrame

from .common import docs_of, small_batches

#: Fixed values of this kind of vocabulary: its splitting pattern, its mark of a word's end, its white space.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
END = "</w>"
SPACE = regex.compile("[\t\n\v\f\r \x85\xa0  -     　]+")
NOT_SPACE = "\x1c\x1d\x1e\x1f"  # str.split() cuts there, the pattern's white space doesn't
LITTLE = sys.byteorder == "little" and array("I").itemsize == 4
MARKS = ".,!?;:|"
LAST = 0x1000  # added to the last character of a word: one character for "x" + END


def as_bytes(ids) -> bytes:
    """32-bit little-endian: small, and not the garbage collector's concern."""
    return array("I", ids).tobytes() if LITTLE else b"".join([i.to_bytes(4, "little") for i in ids])


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END:
            raise ValueError("a BPE vocabulary with word ends is needed")
        ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        size = max(max(ids.values()), *self.special.values()) + 1
        #: offset table for decoding: token i is blob[offset[i]:offset[i + 1]]
        names = {i: t for t, i in ids.items()} | {i: t for t, i in self.special.items()}
        self.blob = "".join(names.get(i, "") for i in range(size))
        self.offset = [0]
        for i in range(size):
            self.offset.append(self.offset[-1] + len(names.get(i, "")))
        self.bytes = byte_characters()
        self.rank: dict[tuple[int, int], int] = {}
        self.made = [-1] * size  # by which merge a token comes about
        self.parts: list[tuple[int, int] | None] = [None] * size
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            one, two, both = ids[a], ids[b], ids[a + b]
            self.rank.setdefault((one, two), r)
            if self.parts[both] is None:
                self.made[both], self.parts[both] = r, (one, two)
        self.fits: dict[int, bool] = {}
        self.length = [0] * size
        self.whole: dict[str, int] = {}
        self.single: dict[str, int] = {}
        self.machine = Automaton()  # of all tokens of two symbols or more
        for token, i in ids.items():
            if token not in self.special and (self.parts[i] is None or self.stands(*self.parts[i])):
                key = self.packed(token)
                self.whole[key] = i
                self.length[i] = len(key)
                if len(key) == 1:
                    self.single[key] = i
                else:
                    self.machine.add_word(key, i)
        self.machine.make_automaton()
        self.bytes_table = str.maketrans({chr(i): c for i, c in enumerate(self.bytes) if chr(i) != c})
        self.ends = {c: chr(ord(c) + LAST) for c in self.bytes}
        self.words = Lately(lambda word: as_bytes(self.word(self.symbols(word))), 500_000)
        #: whether letters, or letters and one mark, hold no special token
        self.plain = all(sum(not c.isalpha() for c in t) > 1 for t in self.special)

    def symbols(self, word: str) -> str:
        """A word with one character for each byte, the last one marked."""
        if not (word.isascii() and word.isprintable()):
            word = word.encode().decode("latin-1").translate(self.bytes_table)
        return word[:-1] + self.ends[word[-1]]

    @staticmethod
    def packed(token: str) -> str:
        """A token with one character for each symbol."""
        if token.endswith(END) and len(token) > len(END):
            token = token[: -len(END)]
            return token[:-1] + chr(ord(token[-1]) + LAST)
        return token

    def stands(self, a: int, b: int) -> bool:
        """Whether the merges join a and b at last: nothing across their border was to be merged before they were whole."""
        return self.apart(a, b, self.rank[a, b])

    def apart(self, a: int, b: int, before: float = float("inf")) -> bool:
        """Whether no merge across the border of a and b comes in time, undoing the later of the two tokens' merges again and again.

        A merge across comes in time if its rank is below that of the merge that used up the left token, or not above
        that of the merge that used up the right one: equal merges run from the left.
        """
        limit = before
        while True:
            r = self.rank.get((a, b))
            if r is not None and r < limit:
                return False
            if self.made[a] > self.made[b]:
                limit, a = self.made[a], self.parts[a][1]
            elif self.parts[b] is not None:
                limit, b = self.made[b] + 1, self.parts[b][0]
            else:
                return True

    def compatible(self, a: int, b: int) -> bool:
        known = self.fits.get(a << 32 | b)
        if known is None:
            if len(self.fits) >= 500_000:  # a bounded table
                self.fits.clear()
            known = self.fits[a << 32 | b] = self.apart(a, b)
        return known

    def word(self, packed: str) -> tuple[int, ...]:
        """The tokens of one word."""
        single = self.whole.get(packed)
        if single is not None:
            return (single,)
        length, fits, single = self.length, self.fits, self.single
        n = len(packed)
        if n < 3:
            return self.stepped(packed)
        # the longest match from each place on: right if all neighbours fit, as only one way of cutting does
        out: list[int] = []
        place, last = 0, -1
        for end, token in self.machine.iter_long(packed):
            while place + length[token] <= end:  # symbols between matches
                x = single[packed[place]]
                if last >= 0 and not ((fit := fits.get(last << 32 | x)) or (fit is None and self.compatible(last, x))):
                    return self.stepped(packed)
                out.append(last := x)
                place += 1
            if last >= 0 and not ((fit := fits.get(last << 32 | token)) or (fit is None and self.compatible(last, token))):
                return self.stepped(packed)
            out.append(last := token)
            place = end + 1
        return tuple(out) if place == n else self.stepped(packed)

    def stepped(self, packed: str) -> tuple[int, ...]:
        """The tokens of a word, with steps back."""
        length, fits, single = self.length, self.fits, self.single
        n = len(packed)
        at = [[single[c]] for c in packed]  # tokens that begin at each place and are yet to be tried, longest last
        for end, token in self.machine.iter(packed):
            at[end + 1 - length[token]].append(token)
        out: list[int] = []
        place, last = 0, -1
        while place < n:
            options = at[place]
            while options:
                token = options.pop()
                fit = True if last < 0 else fits.get(last << 32 | token)
                if fit or (fit is None and self.compatible(last, token)):
                    out.append(token)
                    place += length[token]
                    last = token
                    break
            else:  # a step back; as all options of this place are used up, it is not entered again
                if not out:
                    raise ValueError(f"no tokens for {packed!r}")
                place -= length[out.pop()]
                last = out[-1] if out else -1
        return tuple(out)

    def piece(self, piece: str) -> bytes:
        """The ids of a text without special tokens, as in ``as_bytes``."""
        text = piece.lower() if piece.isascii() else unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()
        if text.isalpha():  # letters only, or followed by one mark: what the pattern would find
            return self.words[text]
        if text[:-1].isalpha() and text[-1] in MARKS:
            return self.words[text[:-1]] + self.words[text[-1]]
        return b"".join([self.words[w] for w in WORDS.findall(text)])

    def pieces(self, text: str) -> list[str]:
        """The text cut where no token goes across; special tokens are pieces of their own."""
        if any([t in text for t in self.special]):
            return [p for part in self.cut.split(text) for p in ([part] if part in self.special else self.pieces(part))]
        if any([c in text for c in NOT_SPACE]):
            return [p for p in SPACE.split(text) if p]
        return text.split()

    def encoded(self, text: str) -> bytes:
        """The ids of a text, as in ``as_bytes``."""
        if self.plain and text[:-1].isalpha() and (text[-1] in MARKS or text[-1].isalpha()):
            return self.piece(text)
        return b"".join([as_bytes([self.special[p]]) if p in self.special else self.piece(p) for p in self.pieces(text)])

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encoded(text or ""), "<u4").tolist()

    def decode(self, ids) -> str:
        """The tokens' texts with spaces between: such a vocabulary has no decoder of its own."""
        blob, offset = self.blob, self.offset
        return " ".join([blob[offset[i] : offset[i + 1]] for i in ids])


class Lately(dict):
    """Results of ``make`` for the keys used lately: at ``limit`` keys a new generation begins, and the one before stays readable.

    twice: only keys that are met twice are kept, by a table of hashes seen; most keys of a text are met once.
    """

    def __init__(self, make: Callable, limit: int, longest: int = 64, twice: bool = False):
        self.make, self.limit, self.longest, self.old = make, limit, longest, {}
        self.seen = bytearray(1 << 22) if twice else None

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.longest:
                return value
            if self.seen is not None and not self.seen[at := hash(key) & 0x3FFFFF]:
                self.seen[at] = 1
                return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
            if self.seen is not None:
                self.seen = bytearray(1 << 22)
        self[key] = value
        return value


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    """Read once per worker."""
    return Vocabulary(path)


@lru_cache(2)
def pieces(path: str) -> Lately:
    """Each piece's ids as text, their number, and their decoding."""
    v = vocabulary(path)

    def text(piece: str) -> tuple[str, int, str]:
        ids = v.encode(piece)
        return " ".join(map(str, ids)), len(ids), v.decode(ids)

    return Lately(text, 400_000, twice=True)


def slices(batches, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text, or of one longer text."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        at = 0
        for i, n in enumerate(pc.binary_length(b.column("text")).fill_null(0).to_pylist()):
            if size and size + n > most:
                yield pa.concat_batches([*held, b.slice(at, i - at)])
                held, at, size = [], i, 0
            size += n
        held.append(b.slice(at))
    if held:
        yield pa.concat_batches(held)


def numbered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Where each text's pieces begin (and the last one's end), the number of each piece, and the distinct pieces by number.

    Texts are cut at ASCII white space, across which no token goes; a null text has one empty piece.
    """
    lists = pc.ascii_split_whitespace(texts.fill_null("").cast(pa.large_string()))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    found = lists.flatten().dictionary_encode()
    return offsets - offsets[0], found.indices.to_numpy().astype(np.int64), found.dictionary.to_numpy(zero_copy_only=False).tolist()


def batch_ids(texts: pa.Array, of: Callable[[list[str]], list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Where each text's ids begin (and the last one's end), and all ids. of: the ids of each of many pieces."""
    offsets, codes, distinct = numbered(texts)
    found = of(distinct)
    sizes = np.array([len(x) // 4 for x in found], np.int64)
    flat = np.frombuffer(b"".join(found), "<u4")
    ends = np.append(0, np.cumsum(sizes[codes]))
    first = (np.cumsum(sizes) - sizes)[codes]  # of each piece among the distinct ones' ids
    place = np.repeat(first - ends[:-1], sizes[codes])
    place += np.arange(ends[-1])
    return ends[offsets], flat[place]


def encode_texts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int), decoded (string), one row per document; a null text is empty."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in batches:
            ids = [v.encode(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([v.decode(i) for i in ids])], ["doc_id", "ids", "decoded"])

    small_batches(df.sparkSession)
    return docs_of(df, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def token_digests(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: ``encode_texts`` and its decoding, reduced in the same pass.

    Null and empty texts have no tokens and the digests of an empty text; repeated rows give repeated rows.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        known = pieces(path)
        for b in slices(batches):
            offsets, codes, distinct = numbered(b.column("text"))
            found = [known[p] for p in distinct]
            sizes = np.array([x[1] for x in found], np.int64)
            if not sizes.all():  # no separator around a piece without tokens
                some = sizes[codes] > 0
                offsets, codes = np.append(0, np.cumsum(some))[offsets], codes[some]
            ends = np.append(0, np.cumsum(sizes[codes]))[offsets]
            digests = []
            for part in (0, 2):
                each = pa.array([x[part] for x in found], pa.large_string()).take(pa.array(codes))
                joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets), each), pa.scalar(" ", pa.large_string()))
                digests.append(pa.array([hashlib.sha256(t).hexdigest() for t in joined.cast(pa.large_binary()).to_pylist()], pa.string()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(ends)), *digests], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    small_batches(df.sparkSession)
    return docs_of(df, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
