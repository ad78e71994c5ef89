"""Benchmark decontamination with a distributed positional inverted index.

`build_index` reads documents in segments of whole documents and stores, for each segment and bucket of
terms, the terms with their positions in the segment. Documents of a segment are set apart by a gap, so no
match runs from one into the next. `search` takes the test set's terms, adds up how often each occurs in the
corpus, brings a segment's postings of those terms together and intersects them, shifted by their place in
the phrase, from the rarest term on. Without a span it finds exact phrases, with one all places where the
terms stand, in any order, within that many words.

Words are runs of ASCII digits, letters (A-Z folded) and all characters from U+0080 on. Null texts have no
words. Items that repeat an id count as one item; a null id reads as the empty string. Repeated documents
are reported as often as they occur. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwright.llm.common import Batches, give_back, lean, offsets_of, one_string_column, ranges, store, texts_of

WINDOW = 10
SEGMENT_WORDS = 1 << 19
TERM_BUCKETS = 32
MAX_QUERY_WORDS = 20_000_000

_FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.lower().translate(_FOLD).split()


class _Segment:
    """Documents of one segment while it is filled."""

    def __init__(self):
        self.terms: dict[bytes, int] = {}
        self.ids, self.docs, self.used = [], [], 0

    def add(self, row: int, text: bytes) -> None:
        found = words(text)
        for word in set(found):
            self.terms.setdefault(word, len(self.terms))
        self.ids.append(np.fromiter(map(self.terms.__getitem__, found), np.int32, len(found)))
        self.docs.append((row, self.used, len(found)))
        self.used += len(found) + 1  # a gap after each document

    def postings(self):
        """(bucket, terms, counts, positions) for each bucket of terms."""
        lengths = np.array([n for _, _, n in self.docs], np.int64)
        first = np.array([f for _, f, _ in self.docs], np.int64)
        ids = np.concatenate([*self.ids, np.zeros(0, np.int32)])
        order = np.argsort(ids, kind="stable")
        positions = ranges(first, lengths)[order].astype("<u4")
        counts = np.bincount(ids, minlength=len(self.terms))
        starts = offsets_of(counts)
        names = list(self.terms)
        bucket = np.array([bucket_of(t) for t in names], np.int64)
        for b in range(TERM_BUCKETS):
            own = np.flatnonzero(bucket == b)
            if len(own):
                yield (b, b" ".join(names[i] for i in own), counts[own].astype("<u4").tobytes(),
                       positions[ranges(starts[own], counts[own])].tobytes())


def bucket_of(term: bytes) -> int:
    """A term's bucket: the same in every process."""
    return sum(term[:16]) % TERM_BUCKETS


def build_index(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """Stored rows: a segment's documents (bucket -1: doc_ids, first, lengths) and its term buckets."""
    key = docs.schema[doc_id].dataType.simpleString()
    names = ["segment", "bucket", "doc_ids", "terms", "counts", "positions"]

    def rows_of(segment: int, s: _Segment, keys: list, kind: pa.DataType):
        first = np.array([f for _, f, _ in s.docs], "<u4").tobytes()
        lengths = np.array([n for _, _, n in s.docs], "<u4").tobytes()
        rows = [(segment, -1, keys, None, lengths, first)]
        rows += [(segment, b, None, t, c, p) for b, t, c, p in s.postings()]
        types = [pa.int64(), pa.int32(), pa.list_(kind), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                                          names=names)

    def run(batches: Batches) -> Batches:
        number, segment, keys = TaskContext.get().partitionId() << 32, _Segment(), []
        kind = pa.int64()
        for batch in batches:
            kind = batch.column(0).type
            for row, (k, t) in enumerate(zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True)):
                segment.add(row, t)
                keys.append(k)
                if segment.used >= segment_words:
                    yield rows_of(number, segment, keys, kind)
                    number, segment, keys = number + 1, _Segment(), []
        if keys:
            yield rows_of(number, segment, keys, kind)

    rows = docs.select(docs[doc_id].alias("doc_id"), one_string_column(docs, text))
    return store(rows.mapInArrow(lean(run), f"segment long, bucket int, doc_ids array<{key}>, terms binary, "
                                      "counts binary, positions binary"), "postings")


def read_items(benchmark: DataFrame, text: str = "text", item_id: str = "item_id") -> list[tuple[str, list[bytes]]]:
    """The test set, whose size is checked before it is sent to every task."""
    size = benchmark.agg(F.sum(F.length(text))).first()[0] or 0
    if size > 6 * MAX_QUERY_WORDS:
        raise ValueError(f"a test set of {size} characters; at most {6 * MAX_QUERY_WORDS} at once: search it in blocks")
    rows = benchmark.select(one_string_column(benchmark, item_id, "item"), one_string_column(benchmark, text)).collect()
    return sorted((r["item"], words(r["text"].encode("utf-8", "surrogatepass"))) for r in rows)


def windows(items: list[tuple[str, list[bytes]]], size: int = WINDOW) -> list[tuple[str, tuple[bytes, ...]]]:
    """Every run of `size` words of each item; a shorter item as it is. Each phrase once per item."""
    out = {}
    for item, found in items:
        for i in range(max(1, len(found) - size + 1) if found else 0):
            out[item, tuple(found[i:i + size])] = None
    return list(out)


def term_counts(index: DataFrame, terms: frozenset[bytes]) -> dict[bytes, int]:
    """Occurrences in the whole corpus of the test set's terms."""
    buckets = sorted({bucket_of(t) for t in terms})

    def run(batches: Batches) -> Batches:
        total: dict[bytes, int] = {}
        for batch in batches:
            for names, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for term, n in zip(names.split(b" "), np.frombuffer(counts, "<u4").tolist(), strict=True):
                    if term in terms:
                        total[term] = total.get(term, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.binary()), pa.array(total.values(), pa.int64())],
                                         names=["term", "n"])

    rows = index.filter(F.col("bucket").isin(buckets)).select("terms", "counts").mapInArrow(lean(run), "term binary, n long")
    return {bytes(r["term"]): r["n"] for r in rows.groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator()}


def phrase_starts(phrase, postings: dict[bytes, np.ndarray], counts: dict[bytes, int]) -> np.ndarray:
    """Where a phrase begins: shifted lists are intersected from the corpus's rarest term on."""
    empty = np.zeros(0, np.int64)
    if any(w not in postings for w in phrase):
        return empty
    starts = None
    for place, word in sorted(enumerate(phrase), key=lambda x: counts[x[1]]):
        held = postings[word]
        if starts is None:
            starts = held[held >= place] - place
            continue
        at = np.searchsorted(held, starts + place)
        at[at == len(held)] = 0
        starts = starts[held[at] == starts + place]
        if not len(starts):
            break
    return starts


def near_starts(terms, postings: dict[bytes, np.ndarray], counts: dict[bytes, int], span: int, ends: np.ndarray):
    """First words of the shortest runs, of at most `span` words, that hold all terms in any order."""
    terms = sorted(set(terms), key=counts.get) if all(t in postings for t in terms) else []
    if not terms:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rare = postings[terms[0]]
    starts = np.unique(np.concatenate([postings[t] for t in terms]))
    at = np.searchsorted(rare, starts)  # only places with the rarest term near enough
    after = rare[np.minimum(at, len(rare) - 1)]
    starts = starts[(after >= starts) & (after < starts + span)]
    last = starts.copy()
    for term in terms:
        held = postings[term]
        at = np.searchsorted(held, starts)
        good = at < len(held)
        starts, last, at = starts[good], last[good], at[good]
        last = np.maximum(last, held[at])
    one_document = ends[np.searchsorted(ends, starts, "right")] > last
    good = (last - starts < span) & one_document
    starts, last = starts[good], last[good]
    # Of runs with the same end only the shortest counts.
    shortest = np.append(last[1:] != last[:-1], True) if len(last) else np.zeros(0, bool)
    return starts[shortest], (last - starts + 1)[shortest]


def _needed(index: DataFrame, terms: frozenset[bytes]) -> DataFrame:
    """(segment, terms, counts, positions): the test terms' postings of each segment."""
    buckets = sorted({bucket_of(t) for t in terms})

    def run(batches: Batches) -> Batches:
        for batch in batches:
            segments, names, sizes, places = [], [], [], []
            for segment, held, counts, positions in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held, counts = held.split(b" "), np.frombuffer(counts, "<u4").astype(np.int64)
                own = np.array([i for i, t in enumerate(held) if t in terms], np.int64)
                starts = offsets_of(counts)
                segments.append(segment)
                names.append(b" ".join(held[i] for i in own))
                sizes.append(counts[own].astype("<u4").tobytes())
                places.append(np.frombuffer(positions, "<u4")[ranges(starts[own], counts[own])].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(segments, pa.int64()), *(
                pa.array(c, pa.binary()) for c in (names, sizes, places))],
                names=["segment", "terms", "counts", "positions"])

    return index.filter(F.col("bucket").isin(buckets)).select("segment", "terms", "counts", "positions").mapInArrow(
        lean(run), "segment long, terms binary, counts binary, positions binary")


def _postings(table: pa.Table) -> dict[bytes, np.ndarray]:
    out = {}
    for names, counts, positions in zip(*(table[c].to_pylist() for c in ("terms", "counts", "positions")), strict=True):
        counts, positions = np.frombuffer(counts, "<u4"), np.frombuffer(positions, "<u4").astype(np.int64)
        starts = offsets_of(counts)
        for i, term in enumerate(names.split(b" ") if names else []):
            out[term] = positions[starts[i]:starts[i + 1]]
    return out


def _per_segment(index: DataFrame, phrases, answer, schema: str) -> DataFrame:
    """answer(doc_ids, first, lengths, postings, counts) for each segment, as a table of the schema."""
    terms = frozenset(w for _, p in phrases for w in p)
    counts = term_counts(index, terms)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        first = np.frombuffer(left["positions"][0].as_py(), "<u4").astype(np.int64)
        lengths = np.frombuffer(left["counts"][0].as_py(), "<u4").astype(np.int64)
        try:
            return answer(left["doc_ids"].chunk(0).flatten(), first, lengths, _postings(right), counts)
        finally:
            give_back()

    docs = index.filter("bucket = -1").select("segment", "doc_ids", "counts", "positions")
    return docs.groupBy("segment").cogroup(_needed(index, terms).groupBy("segment")).applyInArrow(run, schema)


def _key_type(index: DataFrame) -> str:
    return index.schema["doc_ids"].dataType.elementType.simpleString()


def search(index: DataFrame, phrases: list[tuple[str, tuple[bytes, ...]]], span: int | None = None) -> DataFrame:
    """(item_id, doc_id, position, length) of every match; positions count the document's words from 0."""

    def answer(doc_ids, first, lengths, postings, counts) -> pa.Table:
        items, docs, places, sizes = [], [], [], []
        for item, phrase in phrases:
            if span is None:
                starts = phrase_starts(phrase, postings, counts)
                ends = np.full(len(starts), len(phrase))
            else:
                starts, ends = near_starts(phrase, postings, counts, span, first + lengths + 1)
            doc = np.searchsorted(first, starts, "right") - 1
            items += [item] * len(starts)
            docs += doc.tolist()
            places += (starts - first[doc]).tolist()
            sizes += ends.tolist()
        return pa.table({"item_id": pa.array(items, pa.string()), "doc_id": doc_ids.take(pa.array(docs, pa.int64())),
                         "position": pa.array(places, pa.int64()), "length": pa.array(sizes, pa.int64())})

    return _per_segment(index, phrases, answer,
                        f"item_id string, doc_id {_key_type(index)}, position long, length long")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text",
                  doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id",
                  segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, item_ids."""
    phrases = windows(read_items(benchmark, item_text, item_id), window)
    index = build_index(docs, text, doc_id, segment_words)

    def answer(doc_ids, first, lengths, postings, counts) -> pa.Table:
        hit, items = [np.zeros(0, np.int64)], {}
        for item, phrase in phrases:
            starts = phrase_starts(phrase, postings, counts)
            if len(starts):
                hit.append((starts[:, None] + np.arange(len(phrase))).ravel())
                for d in np.unique(np.searchsorted(first, starts, "right") - 1).tolist():
                    items.setdefault(d, set()).add(item)
        marked = np.unique(np.concatenate(hit))
        n_hit = np.bincount(np.searchsorted(first, marked, "right") - 1, minlength=len(first))
        named = [sorted(items.get(d, ())) for d in range(len(first))]
        return pa.table({
            "doc_id": doc_ids, "n_words": pa.array(lengths), "n_hit": pa.array(n_hit.astype(np.int64)),
            "n_items": pa.array([len(n) for n in named], pa.int64()),
            "items_sha256": [hashlib.sha256(",".join(n).encode()).hexdigest() for n in named],
            "contaminated": pa.array(n_hit > 0), "item_ids": pa.array(named, pa.list_(pa.string()))})

    return _per_segment(index, phrases, answer,
                        f"doc_id {_key_type(index)}, n_words long, n_hit long, n_items long, items_sha256 string, "
                        "contaminated boolean, item_ids array<string>")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text",
                      doc_id: str = "doc_id") -> DataFrame:
    """The rows without any benchmark window, with all their columns; `doc_id` is taken for the table's key."""
    found = contamination(docs, benchmark, window, text, doc_id).filter("contaminated")
    bad = found.select(F.col("doc_id").alias("contaminated_id")).distinct()
    return docs.join(bad, docs[doc_id].eqNullSafe(bad["contaminated_id"]), "left_anti")


def drop_contaminated_rows(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                           text: str = "text") -> DataFrame:
    """The rows without any benchmark window, with all their columns.

    Rows are judged by their texts: ids may be missing or repeat, and are not read.
    """
    digest = F.unhex(F.sha2(F.coalesce(docs[text].cast("string"), F.lit("")), 256))
    texts = docs.select(digest.alias("digest"), docs[text].alias("text"))
    found = contamination(texts, benchmark, window, "text", "digest").filter("contaminated")
    # Digests are new and distinct columns on both sides, whatever the table's own are called.
    bad = found.select(F.col("doc_id").alias("contaminated_digest")).distinct()
    return docs.join(bad, digest == bad["contaminated_digest"], "left_anti")
