"""Token ids by the tokenizers library, for operators that need ids but not an encoder of their own.

The library spends most of its time on bookkeeping around short words. So distinct pieces (``bpe.numbered``) are gathered by
the ten thousands, normalised and cut into words at once, and the library's merges run on all their words in one call.
Every word ends with one token that is marked as a word's end, which tells the pieces' ids apart again.
"""

from __future__ import annotations

import os
import unicodedata
from functools import lru_cache

import numpy as np
import regex
import tokenizers

from .bpe import END, WORDS, byte_characters

BREAK = "\n"  # between pieces: white space, so never part of one
FOUND = regex.compile(BREAK + "|" + WORDS.pattern)


class LibraryIds:
    """The ids of pieces without ASCII white space, as 32-bit little-endian bytes.

    Pieces met twice are kept, in two generations of at most ``limit``: like ``bpe.Lately``, for many keys at a time.
    """

    def __init__(self, path: str, at_once: int = 20_000, limit: int = 400_000, longest: int = 64):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task for each core
        self.whole = tokenizers.Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.merges = tokenizers.Tokenizer(self.whole.model)
        self.merges.pre_tokenizer = tokenizers.pre_tokenizers.WhitespaceSplit()
        names = self.whole.get_vocab(with_added_tokens=True)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.ends = np.zeros(max(names.values()) + 1, bool)
        for name, i in names.items():
            self.ends[i] = name.endswith(END) and name not in self.special
        self.shown = np.array([ord(c) for c in byte_characters()], "<u2")
        self.shown[[ord(" "), ord(BREAK)]] = ord(" "), ord(BREAK)
        self.at_once, self.limit, self.longest = at_once, limit, longest
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.seen = bytearray(1 << 22)

    def of(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece."""
        known, old = self.known, self.old
        out = [known.get(p) for p in pieces]
        todo = []
        for i, ids in enumerate(out):
            if ids is None:
                ids = out[i] = old.get(pieces[i])
                if ids is None:
                    todo.append(i)
                else:
                    known[pieces[i]] = ids
        for at in range(0, len(todo), self.at_once):
            part = todo[at : at + self.at_once]
            for i, ids in zip(part, self.fresh([pieces[i] for i in part]), strict=True):
                out[i] = ids
                self.keep(pieces[i], ids)
        if len(known) >= self.limit:
            self.known, self.old, self.seen = {}, known, bytearray(1 << 22)
        return out

    def keep(self, piece: str, ids: bytes) -> None:
        at = hash(piece) & 0x3FFFFF
        if not self.seen[at]:
            self.seen[at] = 1
        elif len(piece) <= self.longest and len(self.known) < self.limit:
            self.known[piece] = ids

    def fresh(self, pieces: list[str]) -> list[bytes]:
        text = BREAK.join(pieces)
        if any([t in text for t in self.special]):
            return self.one_by_one(pieces)
        text = text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        found = FOUND.findall(text)
        breaks = np.flatnonzero(np.fromiter((w == BREAK for w in found), bool, len(found)))
        words_to = np.append(breaks - np.arange(len(breaks)), len(found) - len(breaks))  # words up to each piece's end
        shown = self.shown[np.frombuffer(" ".join(found).encode(), np.uint8)].tobytes().decode("utf-16-le")
        ids = np.array(self.merges.encode_batch_fast([shown], add_special_tokens=False)[0].ids, "<u4")
        word_ends = np.append(0, np.flatnonzero(self.ends[ids]) + 1)
        if len(words_to) != len(pieces) or len(word_ends) != words_to[-1] + 1 or word_ends[-1] != len(ids):
            return self.one_by_one(pieces)
        raw, cuts = ids.tobytes(), [0, *(4 * word_ends[words_to]).tolist()]
        return [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def one_by_one(self, pieces: list[str]) -> list[bytes]:
        """By the whole tokenizer: for pieces with special tokens, and for vocabularies in which words can't be told apart."""
        return [np.array(e.ids, "<u4").tobytes() for e in self.whole.encode_batch_fast(pieces, add_special_tokens=False)]


@lru_cache(2)
def library_ids(path: str) -> LibraryIds:
    """Read once per worker."""
    return LibraryIds(path)
