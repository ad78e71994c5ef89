"""Exact duplicates by content-defined chunk recipes.

A text (null counts as empty; each run of blanks, tabs and line ends becomes one space) is cut where a
rolling hash of its last 32 bytes says so. Its recipe is the ordered list of its chunks' identifiers. Equal
texts have equal recipes; for the converse the identifiers are verified: chunk contents are brought together
once, repeats left out before the shuffle, and an identifier shared by different contents is split. After
that only recipes move, never long texts.

Empty tables give empty results. Equal texts stay once: the row with the smallest `doc_id` (a row without
`doc_id` only if no other has one); of rows that repeat both `doc_id` and text one stays. Other columns are
not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwright.llm.common import Batches, lean, one_string_column, set_aside, store, texts_of

WINDOW_DOUBLINGS = 5  # a window of 2**5 bytes
MIN_CHUNK, MAX_CHUNK, CUT_BITS = 512, 8192, 11
ID_BYTES = 16

_BLANKS = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
_RUNS = re.compile(b" {2,}")
_GEAR = np.random.default_rng(20240229).integers(0, 2**32, 256, dtype=np.uint32)


def normalise(text: bytes) -> bytes:
    return _RUNS.sub(b" ", text.translate(_BLANKS))


def cuts(text: bytes) -> list[int]:
    """Chunk ends of a text, which depend on nothing but its content."""
    if len(text) <= MIN_CHUNK:
        return [len(text)] if text else []
    h = _GEAR[np.frombuffer(text, np.uint8)]
    for k in range(WINDOW_DOUBLINGS):
        # The hash of 2w bytes is that of the last w plus that of the w before them, shifted.
        w = 1 << k
        h[w:] += h[:-w] << np.uint32(w)
    marks = np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1
    out, begin, i = [], 0, 0
    while len(text) - begin > MIN_CHUNK:
        i = int(np.searchsorted(marks, begin + MIN_CHUNK))
        end = int(marks[i]) if i < len(marks) else len(text)
        end = min(end, begin + MAX_CHUNK, len(text))
        out.append(end)
        begin = end
    if begin < len(text):
        out.append(len(text))
    return out


def chunks(text: bytes, id_bytes: int = ID_BYTES) -> list[tuple[bytes, bytes]]:
    """(identifier, content) of the chunks in order."""
    out, begin = [], 0
    for end in cuts(text):
        out.append((hashlib.blake2b(text[begin:end], digest_size=id_bytes).digest(), text[begin:end]))
        begin = end
    return out


def recipes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", id_bytes: int = ID_BYTES) -> DataFrame:
    """One row per document: doc_id, text_sha256 of the normalised text, recipe (identifiers, joined)."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            normal = [normalise(t) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([hashlib.sha256(t).hexdigest() for t in normal]),
                pa.array([b"".join(i for i, _ in chunks(t, id_bytes)) for t in normal], pa.binary())],
                names=["doc_id", "text_sha256", "recipe"])

    return docs.select(docs[doc_id].alias("doc_id"), one_string_column(docs, text)).mapInArrow(
        lean(run), f"doc_id {docs.schema[doc_id].dataType.simpleString()}, text_sha256 string, recipe binary")


def chunk_contents(docs: DataFrame, text: str = "text", id_bytes: int = ID_BYTES) -> DataFrame:
    """(chunk_id, content), each pair once for each task."""

    def run(batches: Batches) -> Batches:
        seen: dict[bytes, set[bytes]] = {}
        for batch in batches:
            new = []
            for value in texts_of(batch.column(0)):
                for key, content in chunks(normalise(value), id_bytes):
                    check = hashlib.sha256(content).digest()
                    if check not in (held := seen.setdefault(key, set())):
                        held.add(check)
                        new.append((key, content))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in new], pa.binary()),
                                              pa.array([c for _, c in new], pa.binary())],
                                             names=["chunk_id", "content"])

    return docs.select(one_string_column(docs, text)).mapInArrow(lean(run), "chunk_id binary, content binary")


def ambiguous_chunks(contents: DataFrame) -> DataFrame:
    """Identifiers that stand for more than one content. Contents are compared byte by byte."""
    return (contents.groupBy("chunk_id").agg(F.count_distinct("content").alias("n"))
            .filter("n > 1").select("chunk_id"))


def _verified(docs: DataFrame, text: str, doc_id: str, id_bytes: int) -> DataFrame:
    """Recipes whose identifiers each stand for one content."""
    listed = recipes(docs, text, doc_id, id_bytes)
    doubtful = store(ambiguous_chunks(chunk_contents(docs, text, id_bytes)), "ambiguous-chunks")
    if doubtful.isEmpty():
        return listed
    # Some identifier is shared by different contents: those chunks are named by the content's digest too.
    number = "row_number"
    rows = docs.select(docs[doc_id].alias("doc_id"), one_string_column(docs, text)).mapInArrow(
        lean(_with_chunks(id_bytes)), f"doc_id {docs.schema[doc_id].dataType.simpleString()}, text_sha256 string, "
        "recipe binary, parts array<struct<pos:int,chunk_id:binary,content_sha256:string>>")
    rows = store(rows.withColumn(number, F.monotonically_increasing_id()), "chunk-lists")
    fixes = (rows.select(number, F.explode("parts").alias("p")).select(number, "p.*").join(doubtful, "chunk_id")
             .groupBy(number).agg(F.array_sort(F.collect_list(F.struct("pos", "content_sha256"))).alias("fix")))
    return rows.join(fixes, number, "left").select(
        "doc_id", "text_sha256",
        F.concat("recipe", F.coalesce(F.to_json("fix"), F.lit("")).cast("binary")).alias("recipe"))


def _with_chunks(id_bytes: int):
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("chunk_id", pa.binary()), ("content_sha256", pa.string())]))

    def run(batches: Batches) -> Batches:
        for batch in batches:
            normal = [normalise(t) for t in texts_of(batch.column(1))]
            found = [chunks(t, id_bytes) for t in normal]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([hashlib.sha256(t).hexdigest() for t in normal]),
                pa.array([b"".join(i for i, _ in f) for f in found], pa.binary()),
                pa.array([[{"pos": n, "chunk_id": i, "content_sha256": hashlib.sha256(c).hexdigest()}
                           for n, (i, c) in enumerate(f)] for f in found], kind)],
                names=["doc_id", "text_sha256", "recipe", "parts"])

    return run


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
                 id_bytes: int = ID_BYTES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    listed = store(_verified(docs, text, doc_id, id_bytes).withColumn(
        "row_number", F.monotonically_increasing_id()), "recipes")
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row_number")
    # Stored, so that both sides of the join are plain exchanges and a large group is split over tasks.
    groups = store(listed.groupBy("recipe").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("group_size")),
                   "recipe-groups")
    return listed.join(groups, "recipe").select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size",
        (F.col("row_number") == F.col("first.row_number")).alias("kept"), "text_sha256")


def keep_first(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows that stay, with all their columns."""
    kept = exact_groups(docs, text, doc_id).filter("kept").select(
        F.col("doc_id").alias("id_that_stays"), F.col("text_sha256").alias("sha256_that_stays"))
    held, names = set_aside(docs)
    normal = F.regexp_replace(F.coalesce(held[names[text]], F.lit("")), "[\\x20\\x09-\\x0D]+", " ")
    marked = held.withColumn("sha256_of_row", F.sha2(normal, 256))
    rows = marked.join(kept, marked["sha256_of_row"].eqNullSafe(kept["sha256_that_stays"])
                       & marked[names[doc_id]].eqNullSafe(kept["id_that_stays"]), "left_semi")
    rows = rows.dropDuplicates([names[doc_id], "sha256_of_row"])
    return rows.select(*(F.col(n).alias(c) for c, n in names.items()))
