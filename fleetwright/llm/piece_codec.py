"""SentencePiece encoding by backtracking over Aho-Corasick matches, and decoding.

The model merges adjacent symbols whose concatenation is a piece, best score first and leftmost among equals.
Every part of a text between two token borders merges as if it stood alone, so a row of tokens is the model's
encoding exactly when each of its adjacent pairs is: when the joined text of the two merges back into the two.
A text is read from the left: the automaton gives the longest piece that begins at a position; it is taken if it
fits the token before it, else its next shorter prefix is tried; where none fits, the position is marked in a bit
field and the token before is shortened. A marked position is never entered again, so work stays linear.

Two characters that stand side by side in no piece are never merged, so a text may be cut between them: before each
run of blanks, and between the characters that pieces connect with letters and all others. Every distinct unit is
encoded once; units are looked up by their whole text. Characters that no piece holds become byte tokens.

A null text is empty and has no ids; any other text begins with the model's extra blank. Repeated and null ids are
kept row by row, an empty table gives an empty one, and columns other than id and text are not read. Texts are
taken whole; a task holds a few megabytes of texts and ids at a time.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from fleetwright.llm.common import Batches, lean, one_string_column

BLANK = "▁"
KEPT_UNITS = 300_000
KEPT_PAIRS = 1_000_000
LONGEST_KEPT = 64
WINDOW = 256
CHARS_TOGETHER = 1 << 20


class PieceModel:
    """The pieces of a model file, with their merge order."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        kinds, norm = sentencepiece_model_pb2.ModelProto.SentencePiece, model.normalizer_spec
        if model.trainer_spec.model_type != model.trainer_spec.BPE or not model.trainer_spec.byte_fallback:
            raise ValueError("the model does not merge pairs with bytes for unknown characters")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("the model changes texts before it splits them")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("the model has pieces that are no merges")
        self.prefix = BLANK if norm.add_dummy_prefix else ""
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        if any(BLANK in p.lstrip(BLANK) for p in self.ids):
            raise ValueError("the model has pieces with a blank inside")
        self.unit = re.compile(_unit_pattern(self.ids))
        self.score = {p.piece: p.score for p in model.pieces if p.type == kinds.NORMAL}
        self.longest = max(map(len, self.ids), default=1)
        self.matches = ahocorasick.Automaton()
        for piece in {*self.ids, *(c for p in self.ids for c in p)}:
            self.matches.add_word(piece, piece)
        self.matches.make_automaton()
        self.fits: dict[tuple[str, str], bool] = {}
        self.shorter: dict[str, str | None] = {}

    def merge(self, text: str) -> list[str]:
        """The symbols of a short text after all merges."""
        parts = list(text)
        while len(parts) > 1:
            scores = [self.score.get(a + b, -np.inf) for a, b in zip(parts, parts[1:], strict=False)]
            best = max(scores)
            if best == -np.inf:
                break
            i = scores.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def fit(self, before: str, piece: str) -> bool:
        """Whether two tokens, or a single one after nothing, merge back into themselves."""
        known = self.fits.get((before, piece))
        if known is None:
            if len(self.fits) >= KEPT_PAIRS:
                self.fits.clear()
            known = self.fits[before, piece] = self.merge(before + piece) == ([before] if before else []) + [piece]
        return known

    def next_shorter(self, piece: str) -> str | None:
        """The longest proper prefix that is a piece or a single character."""
        if piece not in self.shorter:
            self.shorter[piece] = next((piece[:n] for n in range(len(piece) - 1, 0, -1)
                                        if n == 1 or piece[:n] in self.ids), None)
        return self.shorter[piece]

    def _match(self, unit: str, at: int, longest: dict[int, str]) -> str:
        """The longest piece that begins at a position; the matches after it are noted until they meet known ones."""
        if at not in longest:
            window = unit[at:at + WINDOW]
            whole = len(window) - (self.longest if at + WINDOW < len(unit) else 0)
            for end, piece in self.matches.iter_long(window):
                begin = end + 1 - len(piece)
                if begin >= whole or at + begin in longest:
                    break
                longest[at + begin] = piece
        return longest.get(at) or unit[at]

    def tokens(self, unit: str) -> list[str]:
        """The model's tokens of a unit; characters that no piece holds stand alone."""
        out: list[str] = []
        at, before, fits = 0, "", self.fits
        longest: dict[int, str] = {}
        if len(unit) <= WINDOW:
            # Most often the longest matches fit one after another as far as they go.
            for end, piece in self.matches.iter_long(unit):
                longest[end + 1 - len(piece)] = piece
            while (piece := longest.get(at)) is not None:
                known = fits.get((before, piece))
                if not (self.fit(before, piece) if known is None else known):
                    break
                out.append(piece)
                at, before = at + len(piece), piece
        if at == len(unit):
            return out
        failed = bytearray((len(unit) >> 3) + 1)
        piece = self._match(unit, at, longest)
        while at < len(unit):
            while piece is not None:
                end = at + len(piece)
                if not failed[end >> 3] >> (end & 7) & 1 and self.fit(before, piece):
                    break
                piece = self.next_shorter(piece)
            if piece is not None:
                out.append(piece)
                at, before = end, piece
                piece = self._match(unit, at, longest) if at < len(unit) else None
            else:
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                at -= len(piece)
                before = out[-1] if out else ""
                piece = self.next_shorter(piece)
        return out

    def unit_ids(self, unit: str) -> tuple[int, ...]:
        tokens = self.tokens(unit)
        known = tuple(map(self.ids.get, tokens))
        if None not in known:
            return known
        out: list[int] = []
        for token, i in zip(tokens, known, strict=True):
            out += [i] if i is not None else [self.bytes[b] for b in token.encode("utf-8", "replace")]
        return tuple(out)


def _unit_pattern(pieces) -> str:
    """A pattern that cuts texts between the largest set of characters that pieces connect, and the others."""
    up: dict[str, str] = {}

    def root(c: str) -> str:
        while (above := up.setdefault(c, c)) != c:
            up[c] = c = up.setdefault(above, above)
        return c

    for piece in pieces:
        letters = piece.lstrip(BLANK)
        for a, b in zip(letters, letters[1:], strict=False):
            up[root(a)] = root(b)
    sets: dict[str, list[str]] = {}
    for c in list(up):
        sets.setdefault(root(c), []).append(c)
    kept = "".join(re.escape(c) for c in sorted(max(sets.values(), key=len, default=[])))
    return f"{BLANK}*[{kept}]+|{BLANK}*[^{BLANK}{kept}]+|{BLANK}+" if kept else f"{BLANK}*[^{BLANK}]+|{BLANK}+"


class Units(dict):
    """Ids of the units met lately, by their whole text. A full table becomes the one before and frequent units move over."""

    def __init__(self, model: PieceModel):
        super().__init__()
        self.model = model
        self.before: dict[str, tuple[int, ...]] = {}

    def __missing__(self, unit: str) -> tuple[int, ...]:
        ids = self.before.get(unit)
        if ids is None:
            ids = self.model.unit_ids(unit)
        if len(unit) <= LONGEST_KEPT:
            if len(self) >= KEPT_UNITS:
                self.before = dict(self)
                self.clear()
            self[unit] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        return list(chain.from_iterable(map(self.__getitem__, self.model.unit.findall(self.model.prefix + text.replace(" ", BLANK)))))


@lru_cache(maxsize=2)
def units_of(path: str) -> Units:
    """One encoder for each worker process and model file."""
    return Units(PieceModel(path))


@lru_cache(maxsize=2)
def decoder_of(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def _spans(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Runs of rows of about `CHARS_TOGETHER`, at least one row each."""
    if not len(sizes):
        return []
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // CHARS_TOGETHER)) + 1
    edges = [0, *cuts.tolist(), len(sizes)]
    return list(zip(edges, edges[1:], strict=False))


def encode(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids) of every row: the ids of its whole text, without begin or end ids."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Batches) -> Batches:
        units = units_of(model)
        for batch in batches:
            sizes = np.array(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
            for first, last in _spans(sizes):
                part = batch.slice(first, last - first)
                found = [units.encode(t) for t in part.column(1).to_pylist()]
                offsets = np.zeros(len(found) + 1, np.int32)
                np.cumsum([len(ids) for ids in found], out=offsets[1:])
                flat = np.fromiter(chain.from_iterable(found), np.int32, int(offsets[-1]))
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["doc_id", "ids"])

    rows = docs.select(docs[doc_id].alias("doc_id"), one_string_column(docs, text))
    return rows.mapInArrow(lean(run), f"doc_id {kind}, ids array<int>")


def _lists(column: pa.ListArray) -> list[list[int]]:
    """The lists of a column, null as empty; numbers are taken out together."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)).tolist()
    return [flat[a:b].tolist() for a, b in zip([0, *ends], ends, strict=False)]


def _decoded(encoded: DataFrame, model: str, columns: dict[str, str], row) -> DataFrame:
    """(doc_id, columns) where `row(ids, text)` gives the values of the columns for one document."""
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Batches) -> Batches:
        decoder = decoder_of(model)
        for batch in batches:
            sizes = np.array(pc.list_value_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False))
            for first, last in _spans(sizes * 4):
                part = batch.slice(first, last - first)
                done = [row(ids, decoder.decode(ids) if ids else "") for ids in _lists(part.column(1))]
                values = [pa.array([d[i] for d in done], pa.int64() if kind_ == "long" else pa.string())
                          for i, kind_ in enumerate(columns.values())]
                yield pa.RecordBatch.from_arrays([part.column(0), *values], names=["doc_id", *columns])

    schema = ", ".join([f"doc_id {kind}", *[f"{name} {kind_}" for name, kind_ in columns.items()]])
    return encoded.select("doc_id", "ids").mapInArrow(lean(run), schema)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) from the ids of every row; null ids are empty."""
    return _decoded(encoded, model, {"text": "string"}, lambda ids, text: (text,))


def digests(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): counts and digests of ids and decoded texts."""
    def row(ids, text):
        joined = ",".join(map(str, ids))
        return (len(ids), hashlib.sha256(joined.encode()).hexdigest(),
                hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest())

    return _decoded(encoded, model, {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}, row)
