"""Token ids of whole texts, by a public tokenizer file, with each distinct word encoded once.

The tokenizer splits at white space before anything else and never merges across it, so the ids of a text
are the ids of its blank-separated pieces in order. Pieces repeat: a worker keeps the ids of those it has
met in a hash table of numpy arrays, finds all pieces of some texts at once by a 64-bit hash, compares them
byte by byte with the piece kept there, and gathers their ids; a piece that shares another's hash is encoded
by itself. Texts that hold `<|` may hold special tokens, whose strings are matched before case is folded,
and go through the tokenizer whole.
"""

from __future__ import annotations

import os
import re

import numpy as np

from fleetwright.llm.common import keep, offsets_of, ranges, slices, span_hashes, spans_equal, word_spans

KEPT_PIECES = 1_000_000
KEPT_WORDS = 200_000
TOGETHER = 1 << 20
_PLAIN = re.compile("[a-zà-öø-ÿ]+")
_WORD_AND_MARK = re.compile("([a-zà-öø-ÿ]+)([.,;:!?]+)")
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x0A]] = True
_SPREAD = np.uint64(0xD6E8FEB86659FD93)


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordPieces:
    """Ids of texts under a tokenizer that lower-cases, drops white space and never joins across it."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.spell = self._byte_letters()
        self._forget()

    def _forget(self) -> None:
        self.words: dict[str, list[int]] = {}
        self.bits, self.known, self.used = 16, 0, 0
        self.keys, self.rows = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.flat = np.zeros(1 << 16, np.uint32)
        self.start, self.count = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int32)
        # The bytes of the pieces, one after another, and where each begins and how long it is.
        self.spelt, self.spelt_used = np.zeros(1 << 16, np.uint8), 0
        self.begin, self.size = np.zeros(1 << 15, np.int64), np.zeros(1 << 15, np.int64)

    @staticmethod
    def _byte_letters() -> dict[int, str]:
        """Byte-level vocabularies spell printable bytes as themselves, the others from U+0100 on."""
        printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        hidden = [b for b in range(256) if b not in printable]
        return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(hidden)}

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _word(self, word: str) -> list[int]:
        """A lower-case Latin word: normalising and splitting leave it as it is, so the model suffices."""
        ids = self.words.get(word)
        if ids is None:
            if len(self.words) > KEPT_WORDS:
                self.words.clear()
            spelt = word if word.isascii() else "".join(self.spell[b] for b in word.encode())
            ids = self.words[word] = [t.id for t in self.model.tokenize(spelt)]
        return ids

    def _piece(self, piece: bytes) -> list[int]:
        text = piece.decode("utf-8", "surrogatepass")
        if _PLAIN.fullmatch(text):
            return self._word(text)
        if m := _WORD_AND_MARK.fullmatch(text):
            mark = self.words.get(m[2])
            if mark is None:
                mark = self.words[m[2]] = self._whole(m[2])
            return self._word(m[1]) + mark
        return self._whole(text)

    def _slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash, or the empty slot where its search ends."""
        at = (hashes * _SPREAD >> np.uint64(64 - self.bits)).astype(np.int64)
        open_ = np.arange(len(hashes))
        while len(open_):
            held = self.keys[at[open_]]
            open_ = open_[(held != hashes[open_]) & (held != 0)]
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
        return at

    def _place(self, hashes: np.ndarray, rows: np.ndarray) -> None:
        """Put new, distinct hashes into the table; of several that end at one slot the first takes it."""
        while len(hashes):
            slots = self._slots(hashes)
            _, own = np.unique(slots, return_index=True)
            self.keys[slots[own]], self.rows[slots[own]] = hashes[own], rows[own]
            rest = np.ones(len(hashes), bool)
            rest[own] = False
            hashes, rows = hashes[rest], rows[rest]

    def _keep(self, pieces: list[bytes]) -> np.ndarray:
        """The rows of new pieces, with their ids and their bytes."""
        found = [self._piece(p) for p in pieces]
        counts, sizes = (np.array([len(x) for x in xs], np.int64) for xs in (found, pieces))
        first, known = self.known, self.known + len(found)
        ids, letters = self.used + int(counts.sum()), self.spelt_used + int(sizes.sum())
        while ids > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while letters > len(self.spelt):
            self.spelt = np.concatenate([self.spelt, np.zeros_like(self.spelt)])
        while known > len(self.count):
            self.start, self.count, self.begin, self.size = (
                np.concatenate([a, np.zeros_like(a)]) for a in (self.start, self.count, self.begin, self.size))
        self.flat[self.used:ids] = [i for ids in found for i in ids]
        self.spelt[self.spelt_used:letters] = np.frombuffer(b"".join(pieces), np.uint8)
        self.count[first:known], self.size[first:known] = counts, sizes
        self.start[first:known] = self.used + offsets_of(counts)[:-1]
        self.begin[first:known] = self.spelt_used + offsets_of(sizes)[:-1]
        self.known, self.used, self.spelt_used = known, ids, letters
        return np.arange(first, known, dtype=np.int32)

    def _learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        rows = self._keep(pieces)
        if 2 * self.known > len(self.keys):
            full = self.keys != 0
            held, placed = self.keys[full], self.rows[full]
            while 2 * self.known > 1 << self.bits:
                self.bits += 2
            self.keys, self.rows = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
            self._place(held, placed)
        self._place(hashes, rows)

    def _together(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of some texts, all of whose pieces are looked up at once."""
        if self.known > KEPT_PIECES:
            self._forget()
        joined = b" ".join(texts).lower()
        raw = np.frombuffer(joined, np.uint8)
        first, last, hashes = _pieces(raw)
        slots = self._slots(hashes)
        missing = np.flatnonzero(self.keys[slots] == 0)
        if len(missing):
            new, where = np.unique(hashes[missing], return_index=True)
            self._learn(new, [joined[first[i]:last[i]] for i in missing[where].tolist()])
            slots = self._slots(hashes)
        rows = self.rows[slots]
        sizes = last - first
        same = self.size[rows] == sizes
        same[same] = spans_equal(raw, first[same], sizes[same], self.spelt, self.begin[rows[same]])
        other = np.flatnonzero(~same)
        if len(other):
            rows[other] = self._keep([joined[first[i]:last[i]] for i in other.tolist()])
        counts = self.count[rows].astype(np.int64)
        ids = self.flat[ranges(self.start[rows], counts)]
        ends = np.cumsum([len(t) + 1 for t in texts])
        cuts = offsets_of(counts)[np.searchsorted(first, ends)]
        return np.split(ids, cuts[:-1])

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of every text, as unsigned 32-bit arrays."""
        out: list = [None] * len(texts)
        parts: list[tuple[int, bytes]] = []
        size = 0
        for i, text in enumerate(texts):
            if b"<|" in text:
                out[i] = np.array(self._whole(text.decode("utf-8", "surrogatepass")), np.uint32)
                continue
            for part in slices(text, _BLANK, TOGETHER):
                parts.append((i, part))
                size += len(part)
                if size > TOGETHER:
                    self._take(parts, out)
                    parts, size = [], 0
        self._take(parts, out)
        return out

    def _take(self, parts: list[tuple[int, bytes]], out: list) -> None:
        if parts:
            for (i, _), ids in zip(parts, self._together([p for _, p in parts]), strict=True):
                out[i] = ids if out[i] is None else np.concatenate([out[i], ids])


def _pieces(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and hash of the blank-separated pieces; a full stop or comma after a letter is one by itself."""
    first, last = word_spans(raw, _BLANK)
    end, before = raw[last - 1], raw[np.maximum(last - 2, 0)]
    marked = ((end == 0x2E) | (end == 0x2C)) & (last - first > 1) & (before >= 0x61) & (before <= 0x7A)
    last = last - marked
    at = np.flatnonzero(marked) + 1
    first, last = np.insert(first, at, last[marked]), np.insert(last, at, last[marked] + 1)
    hashes = span_hashes(raw, first, last)
    hashes[hashes == 0] = 1
    return first, last, hashes


def word_pieces(path: str) -> WordPieces:
    """One encoder for each worker process and file, which goes when the worker's tasks no longer encode."""
    return keep(WordPieces, path)
