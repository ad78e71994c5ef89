"""Token ids in raw shards, with a minimal perfect hash index from document keys to shard offsets.

`write_shards` sorts documents by `doc_id`, encodes whole texts and appends ids to raw little-endian payload
files (16-bit where the vocabulary allows it). `build_index` deals the keys to buckets of about 2^15 by a
64-bit hash; each bucket is a minimal perfect hash by levels of bit arrays (a key owns the first bit that no
other key of the level hits; its slot is the number of set bits before it), followed by one fixed-width entry
per slot: fingerprint, shard, offset, length. `find` asks a bucket in a constant number of steps; a key that
is not in the index fails the fingerprint but for about one in 2^32.

Null texts are empty and still hold the end id. A null `doc_id` sorts first. Rows that repeat a `doc_id` are
all written, ordered by text, and told apart by `copy` (0, 1, ...). Empty tables give empty results. Other
columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetwright.llm.common import (Batches, file_system, lean, mix64, new_folder, one_string_column, partitions,
                                    store, texts_of)
from fleetwright.llm.tokens import word_pieces

SHARD_IDS = 64 * 1024 * 1024
BUCKET_KEYS = 1 << 15
LEVELS, GAMMA = 24, 2
SHARDS_PER_TASK = 1 << 20
ENTRY = np.dtype([("print", "<u4"), ("n_tokens", "<u4"), ("shard", "<i8"), ("offset", "<i8")])


def id_type(tokenizer: str) -> str:
    return "<u2" if word_pieces(tokenizer).tokenizer.get_vocab_size() <= 1 << 16 else "<u4"


def shard_path(folder: str, shard: int) -> str:
    return f"{folder}/ids-{shard:016d}.bin"


class _Shards:
    """Appends to numbered payload files; each appears under its name only when it is whole."""

    def __init__(self, folder: str, task: int):
        self.system, self.folder = file_system(folder)
        self.next, self.out, self.used = task * SHARDS_PER_TASK, None, 0

    def put(self, ids: np.ndarray) -> tuple[int, int]:
        if self.out is None or self.used + len(ids) > SHARD_IDS:
            self.close()
            self.part = f"{self.folder}/{uuid.uuid4().hex}.part"
            self.out = self.system.open_output_stream(self.part)
        place = self.next, self.used
        self.out.write(ids.tobytes())
        self.used += len(ids)
        return place

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.system.move(self.part, shard_path(self.folder, self.next))
            self.next, self.out, self.used = self.next + 1, None, 0


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int, text: str = "text",
                 doc_id: str = "doc_id") -> DataFrame:
    """Write the payload files; returns the stored manifest (doc_id, copy, shard, offset, n_tokens)."""
    system, inner = file_system(folder)
    system.create_dir(inner, recursive=True)
    kind = id_type(tokenizer)

    def run(batches: Batches) -> Batches:
        shards = _Shards(folder, TaskContext.get().partitionId())
        encoder, before, copy = word_pieces(tokenizer), object(), 0
        for batch in batches:
            rows = []
            keys = batch.column(0).to_pylist()
            for key, ids in zip(keys, encoder.encode(texts_of(batch.column(1))), strict=True):
                copy = copy + 1 if key == before else 0
                before = key
                ids = np.append(ids, end_id).astype(kind)
                rows.append((copy, *shards.put(ids), len(ids)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(4))],
                names=["doc_id", "copy", "shard", "offset", "n_tokens"])
        shards.close()

    ordered = docs.select(docs[doc_id].alias("doc_id"), one_string_column(docs, text))
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    key = docs.schema[doc_id].dataType.simpleString()
    return store(ordered.mapInArrow(
        lean(run), f"doc_id {key}, copy long, shard long, offset long, n_tokens long"), "manifest")


def shard_starts(manifest: DataFrame) -> DataFrame:
    """(shard, first): ids before each shard. One small row for each payload file."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return (manifest.groupBy("shard").agg(F.sum("n_tokens").alias("ids"))
            .select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("first")))


def _keyed(keys: DataFrame, buckets: int) -> DataFrame:
    """Adds key (64 bits, distinct for distinct integers under one copy number), print and bucket."""
    key = F.xxhash64("doc_id", "copy")
    return keys.withColumns({"key": key, "print": F.hash("copy", "doc_id"),
                             "bucket": F.pmod(F.shiftright(key, 20), F.lit(buckets)).cast("int")})


def perfect_hash(keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Bit arrays of the levels, the slot of every key, and the keys that no level could place."""
    levels, slots = [], np.full(len(keys), -1, np.int64)
    left, placed = np.arange(len(keys)), 0
    for level in range(LEVELS):
        if not len(left):
            break
        size = max(64, GAMMA * len(left))
        at = (mix64(keys[left], level) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone)
        own = alone[at]
        slots[left[own]] = placed + np.cumsum(alone)[at[own]] - 1
        placed += int(own.sum())
        left = left[~own]
    slots[left] = placed + np.arange(len(left))
    return levels, slots, keys[left]


def pack_bucket(keys: np.ndarray, entries: np.ndarray) -> bytes:
    levels, slots, left = perfect_hash(keys)
    table = np.empty(len(keys), ENTRY)
    table[slots] = entries
    head = struct.pack(f"<{3 + len(levels)}q", len(keys), len(levels), len(left), *map(len, levels))
    return head + b"".join(np.packbits(b).tobytes() for b in levels) + left.tobytes() + table.tobytes()


def ask_bucket(blob: bytes, keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entry of every key, and whether its fingerprint fits."""
    n, n_levels, n_left = struct.unpack_from("<3q", blob)
    sizes = struct.unpack_from(f"<{n_levels}q", blob, 24)
    at, placed = 24 + 8 * n_levels, 0
    slots, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
    for level, size in enumerate(sizes):
        packed = np.frombuffer(blob, np.uint8, (size + 7) // 8, at)
        bits, at = np.unpackbits(packed, count=size), at + len(packed)
        where = (mix64(keys[open_], level) % np.uint64(size)).astype(np.int64)
        hit = bits[where] == 1
        rank = np.cumsum(bits, dtype=np.int64)
        slots[open_[hit]] = placed + rank[where[hit]] - 1
        placed += int(rank[-1])
        open_ = open_[~hit]
    left = np.frombuffer(blob, np.uint64, n_left, at)
    table = np.frombuffer(blob, ENTRY, n, at + 8 * n_left)
    for i in open_:  # keys that share all their hashes: told apart by the fingerprint
        for j in np.flatnonzero(left == keys[i]):
            if table["print"][placed + j] == prints[i]:
                slots[i] = placed + j
    found = slots >= 0
    out = np.zeros(len(keys), ENTRY)
    out[found] = table[slots[found]]
    return out, found & (out["print"] == prints)


def build_index(manifest: DataFrame) -> DataFrame:
    """Stored rows (bucket, buckets, blob)."""
    buckets = max(1, -(-manifest.count() // BUCKET_KEYS))

    def run(table: pa.Table) -> pa.Table:
        entries = np.empty(table.num_rows, ENTRY)
        entries["print"] = table["print"].to_numpy().astype(np.uint32)
        for name in ("n_tokens", "shard", "offset"):
            entries[name] = table[name].to_numpy()
        blob = pack_bucket(table["key"].to_numpy().astype(np.uint64), entries)
        return pa.table({"bucket": pa.array([table["bucket"][0].as_py()], pa.int32()),
                         "blob": pa.array([blob], pa.binary())})

    rows = _keyed(manifest, buckets).drop("doc_id", "copy")
    index = rows.groupBy("bucket").applyInArrow(run, "bucket int, blob binary")
    return store(index.withColumn("buckets", F.lit(buckets)), "key-index")


def find(keys: DataFrame, index: DataFrame) -> DataFrame:
    """Look up (doc_id, copy): adds shard, offset and n_tokens; keys that are not held are left out."""
    head = index.select("buckets").first()
    buckets = head["buckets"] if head else 1
    kind = keys.schema["doc_id"].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if right.num_rows:
            out, good = ask_bucket(right["blob"][0].as_py(), left["key"].to_numpy().astype(np.uint64),
                                   left["print"].to_numpy().astype(np.uint32))
        else:
            out, good = np.zeros(left.num_rows, ENTRY), np.zeros(left.num_rows, bool)
        kept = left.select(["doc_id", "copy"]).filter(pa.array(good))
        for name in ("shard", "offset", "n_tokens"):
            kept = kept.append_column(name, pa.array(out[name][good].astype(np.int64)))
        return kept

    asked = _keyed(keys.select("doc_id", "copy"), buckets)
    return asked.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInArrow(
        run, f"doc_id {kind}, copy long, shard long, offset long, n_tokens long")


def keys_of(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Every key of a table: a repeated id stands for as many copies as it has rows."""
    counted = docs.groupBy(docs[doc_id].alias("doc_id")).agg(F.count(F.lit(1)).alias("rows"))
    return counted.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("copy"))


def read_digests(places: DataFrame, folder: str, kind: str) -> DataFrame:
    """Read each place's ids from its payload file: adds ids_crc32 (ids as unsigned 32-bit)."""
    width = np.dtype(kind).itemsize
    key = places.schema["doc_id"].dataType.simpleString()

    def run(batches: Batches) -> Batches:
        system, inner = file_system(folder)
        name, source = None, None
        for batch in batches:
            sums = []
            for shard, offset, n in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                if shard != name:
                    name, source = shard, system.open_input_file(shard_path(inner, shard))
                raw = source.read_at(n * width, offset * width)
                sums.append(zlib.crc32(np.frombuffer(raw, kind).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.int64())],
                                             names=[*batch.schema.names, "ids_crc32"])

    # Ranges of a shard are read in order; a large shard is shared by several tasks.
    rows = places.select("doc_id", "copy", "shard", "offset", "n_tokens")
    rows = (rows.repartition(partitions(rows.sparkSession), "shard", F.shiftright("offset", 20))
            .sortWithinPartitions("shard", "offset"))
    return rows.mapInArrow(run, f"doc_id {key}, copy long, shard long, offset long, n_tokens long, ids_crc32 long")


def indexed_tokens(docs: DataFrame, tokenizer: str, end_id: int, text: str = "text",
                   doc_id: str = "doc_id") -> DataFrame:
    """Write, index, look every key up and read it back: doc_id, start, n_tokens, ids_crc32, shard, offset, copy."""
    folder = new_folder(docs.sparkSession, "token-shards")
    manifest = write_shards(docs, folder, tokenizer, end_id, text, doc_id)
    index = build_index(manifest)
    read = read_digests(find(keys_of(docs, doc_id), index), folder, id_type(tokenizer))
    return read.join(shard_starts(manifest), "shard").select(
        "doc_id", (F.col("first") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32",
        "copy", "shard", F.col("offset").alias("shard_offset"))
