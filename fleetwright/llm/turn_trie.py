"""Conversation prefix trie as adaptive radix trees over fixed-width turn ids.

A turn's id is the first 16 bytes of the SHA-256 of its role and text, big-endian; a conversation's key is the ids
of its turns in order. Equal conversations become one key with their number, least id and a digest of their ids.
Distinct keys are sorted and cut into ranges of about `RANGE_BYTES`; each range is one adaptive radix tree: inner
nodes grow from 4 to 16, 48 and 256 children, and paths without a branch are kept in one node. Only byte depths at
the end of a turn give trie nodes.

A trie node whose members lie in several ranges is a prefix of the keys on both sides of a border, so there is one
such node for each border and depth of the common prefix there. Ranges give partial figures for these, everything
else is final; the partial ones are added up and resolved from the deepest on. No task holds more than a range,
a border's common prefixes or one conversation's ids (16 bytes a turn); texts are never gathered.

Rows are ordered by turn (null first), then role, then text; repeated rows are turns of their own. Null roles and
texts are empty. Rows without a conv_id belong to no conversation and are left out. An empty table has no nodes.
Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetwright.llm.common import Batches, lean, partitions, store

WIDTH = 16
RANGE_BYTES = 1 << 22
RANGE_KEYS = 1 << 14
CHUNK_TURNS = 1 << 10
BUCKET_IDS = 1 << 14
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Node:
    """An inner node: the bytes above it, what ends here, and its children in one of four layouts."""

    __slots__ = ("path", "end", "some", "kind", "keys", "kids")

    def __init__(self, path: bytes, end: int | None, some: int):
        # `some` is the number of any key below.
        self.path, self.end, self.some = path, end, some
        # Up to 4 or 16 children: their first bytes in order beside them. Then: a place for every byte.
        self.kind, self.keys, self.kids = 4, bytearray(), []

    def child(self, byte: int) -> Node | None:
        if self.kind <= 16:
            at = bisect_left(self.keys, byte)
            return self.kids[at] if at < len(self.keys) and self.keys[at] == byte else None
        if self.kind == 48:
            at = self.keys[byte]
            return self.kids[at - 1] if at else None
        return self.kids[byte]

    def put(self, byte: int, node: Node) -> None:
        """Add a child, or put another in its place."""
        if self.kind <= 16:
            at = bisect_left(self.keys, byte)
            if at < len(self.keys) and self.keys[at] == byte:
                self.kids[at] = node
                return
            if len(self.keys) < self.kind:
                self.keys.insert(at, byte)
                self.kids.insert(at, node)
                return
        elif self.kind == 48:
            at = self.keys[byte]
            if at:
                self.kids[at - 1] = node
                return
            if len(self.kids) < 48:
                self.kids.append(node)
                self.keys[byte] = len(self.kids)
                return
        else:
            self.kids[byte] = node
            return
        self._grow()
        self.put(byte, node)

    def _grow(self) -> None:
        if self.kind == 4:
            self.kind = 16
        elif self.kind == 16:
            places = bytearray(256)
            for at, byte in enumerate(self.keys):
                places[byte] = at + 1
            self.kind, self.keys = 48, places
        else:
            kids = [None] * 256
            for byte, at in enumerate(self.keys):
                if at:
                    kids[byte] = self.kids[at - 1]
            self.kind, self.keys, self.kids = 256, bytearray(), kids

    def children(self) -> list[Node]:
        """In order of their first byte."""
        if self.kind <= 16:
            return list(self.kids)
        if self.kind == 48:
            return [self.kids[at - 1] for at in self.keys if at]
        return [node for node in self.kids if node is not None]


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


class RadixTree:
    """Keys with a number each, from 0."""

    def __init__(self):
        self.root = Node(b"", None, 0)

    def insert(self, key: bytes, number: int) -> None:
        node, at, above = self.root, 0, None
        while True:
            rest = key[at:at + len(node.path)]
            same = len(rest) if rest == node.path else _common(rest, node.path)
            if same < len(node.path):
                upper = Node(node.path[:same], None, node.some)
                above.put(upper.path[0], upper)
                upper.put(node.path[same], node)
                node.path = node.path[same:]
                node = upper
            at += same
            if at == len(key):
                node.end = number
                return
            below = node.child(key[at])
            if below is None:
                node.put(key[at], Node(key[at:], number, number))
                return
            above, node = node, below


def aligned_nodes(tree: RadixTree, width: int = WIDTH):
    """(parent, depth in turns, number of a key below, number of the key that ends here or None), parents first.

    Only depths at the end of a turn count; a path without a branch gives one node for each of them.
    """
    out = []
    stack = [(tree.root, 0, -1)]
    while stack:
        node, depth, parent = stack.pop()
        end = depth + len(node.path)
        first = 0 if parent < 0 else (depth // width + 1) * width
        for at in range(first, end + 1, width):
            out.append((parent, at // width, node.some, node.end if at == end else None))
            parent = len(out) - 1
        stack.extend((child, end, parent) for child in reversed(node.children()))
    return out


NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, " \
       "saved_tokens long, ends_sha256 string, node binary, parent_node binary, last_words long"
_KINDS = [pa.int64()] * 7 + [pa.string(), pa.binary(), pa.binary(), pa.int64()]
_NAMES = [f.split()[0] for f in NODE.split(", ")]


def _name(prefix: bytes) -> bytes:
    return hashlib.sha256(prefix).digest()


def _range_nodes(keys: list[bytes], words: list[np.ndarray], n: list[int], least: list[int], ends: list[str],
                 left: int, right: int) -> list[tuple]:
    """Rows of `NODE` for the sorted distinct keys of one range.

    `left` and `right` are the depths down to which nodes are shared with the ranges before and after, -1 for none.
    A shared node has a name and partial figures: its members here, and the figures of its own children that are
    not shared. Other rows are final, but for the parent's id where the parent is shared (`parent_node`).
    """
    tree = RadixTree()
    for number, key in enumerate(keys):
        tree.insert(key, number)
    nodes = aligned_nodes(tree)
    count, low = [0] * len(nodes), [None] * len(nodes)
    kids, leaves, saved, shared = ([0] * len(nodes) for _ in range(4))
    names: dict[int, bytes] = {}
    for i, (_, depth, number, end) in enumerate(nodes):
        at = depth * WIDTH
        if depth <= left and keys[number][:at] == keys[0][:at] or depth <= right and keys[number][:at] == keys[-1][:at]:
            shared[i] = 1
            names[i] = _name(keys[number][:at])
        if end is not None:
            count[i], low[i] = n[end], least[end]
    for i in range(len(nodes) - 1, -1, -1):
        parent, depth, number, _ = nodes[i]
        if not shared[i]:
            leaves[i] = leaves[i] or 1
            saved[i] += (count[i] - 1) * int(words[number][depth - 1]) if depth else 0
        if parent >= 0:
            count[parent] += count[i]
            low[parent] = low[i] if low[parent] is None else min(low[parent], low[i])
            if not shared[i]:
                kids[parent] += 1
                leaves[parent] += leaves[i]
                saved[parent] += saved[i]
    out = []
    for i, (parent, depth, number, end) in enumerate(nodes):
        above = names.get(parent)
        out.append((low[i], depth, low[parent] if parent >= 0 and above is None else None, count[i], kids[i], leaves[i],
                    saved[i], EMPTY_SHA if end is None else ends[end], names.get(i), above,
                    int(words[number][depth - 1]) if depth else 0))
    return out


def _resolve(rows: list[tuple]) -> list[tuple]:
    """Final rows of the shared nodes from their partial ones, deepest first. Parents stay named."""
    merged: dict[bytes, list] = {}
    for low, depth, _, n, kids, leaves, saved, ends, node, parent, last in rows:
        held = merged.setdefault(node, [low, depth, None, 0, 0, 0, 0, EMPTY_SHA, node, parent, last])
        held[0] = min(held[0], low)
        for at, value in ((3, n), (4, kids), (5, leaves), (6, saved)):
            held[at] += value
        if ends != EMPTY_SHA:
            held[7] = ends
    for held in sorted(merged.values(), key=lambda h: -h[1]):
        held[5] = held[5] or 1
        held[6] += (held[3] - 1) * held[10]
        above = merged.get(held[9])
        if above is not None:
            above[4] += 1
            above[5] += held[5]
            above[6] += held[6]
    for held in merged.values():
        above = merged.get(held[9])
        held[2] = above[0] if above is not None else None
    return [tuple(held) for held in merged.values()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(_KINDS)], names=_NAMES)


def ordered_turns(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, place, id, words): every turn's place in its conversation from 0, its id and its number of words.

    Turns are dealt by ranges of conversation and turn, so a long conversation is shared by several tasks; the rows
    of a conversation that stand in earlier tasks are added to the places.
    """
    def run(batches: Batches) -> Batches:
        part, key, place = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            places, ids, words = [], [], []
            for conv, said, body in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if conv != key:
                    key, place = conv, 0
                places.append(place)
                place += 1
                said = said.encode("utf-8", "surrogatepass")
                whole = len(said).to_bytes(8, "big") + said + body.encode("utf-8", "surrogatepass")
                ids.append(hashlib.sha256(whole).digest()[:WIDTH])
                words.append(len(_WORD.findall(body)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(places, pa.int64()), pa.array([part] * len(places), pa.int64()),
                 pa.array(ids, pa.binary()), pa.array(words, pa.int64())], names=["conv_id", "place", "part", "id", "words"])

    rows = turns.select(turns[conv_id].cast("long").alias("conv_id"), turns[turn].alias("turn"),
                        *[F.coalesce(turns[c].cast("string"), F.lit("")).alias(n) for c, n in ((role, "role"), (text, "text"))])
    order = ("conv_id", "turn", "role", "text")
    rows = rows.filter("conv_id IS NOT NULL").repartitionByRange("conv_id", "turn", "role", "text").sortWithinPartitions(*order)
    placed = store(rows.mapInArrow(lean(run), "conv_id long, place long, part long, id binary, words long"), "turns")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    starts = counts.select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return placed.join(starts.filter("start > 0"), ["conv_id", "part"], "left").select(
        "conv_id", (F.col("place") + F.coalesce("start", F.lit(0))).alias("place"), "id", "words")


def rebuilt(ordered: DataFrame, block: int = 20, most: int = 4) -> DataFrame:
    """(conv_id, place, id, words) of the rebuilt conversations; one without turns gives one row without a place.

    The first h turns come from the conversation whose id is the next lower multiple of `block`, the others are the
    conversation's own after its first h; h is the checksum of the decimal id modulo `most`. Places only give the
    order: they may leave out some numbers.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    convs = ordered.groupBy("conv_id").agg(F.count("*").alias("own")).select(
        "conv_id", (F.col("conv_id") - F.pmod("conv_id", F.lit(block))).alias("base"), h.alias("h"), "own")
    heads = ordered.filter((F.col("place") < most - 1) & (F.pmod("conv_id", F.lit(block)) == 0)).select(
        F.col("conv_id").alias("base"), "place", "id", "words")
    taken = convs.join(heads, "base", "left").filter(
        (F.col("place") < F.col("h")) | (F.col("own") <= F.col("h")) & F.coalesce(F.col("place") == 0, F.lit(True)))
    used = F.col("place") < F.col("h")
    taken = taken.select("conv_id", *[F.when(used, F.col(c)).alias(c) for c in ("place", "id", "words")])
    return taken.unionByName(ordered.filter(F.col("place") >= h).select("conv_id", "place", "id", "words"))


def _keys(turns: DataFrame, chunk_turns: int) -> DataFrame:
    """(conv_id, digest, key, words) of every conversation: its turn ids in one string of bytes.

    Turns are put together in chunks first, so that few rows of a long conversation move.
    """
    def run(batches: Batches) -> Batches:
        conv, parts, words, done = None, [], [], []

        def close():
            key = b"".join(parts)
            done.append((conv, hashlib.sha256(key).digest(), key, np.array(words, np.int32).tobytes()))

        def out():
            kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
            rows = [pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)]
            done.clear()
            return pa.RecordBatch.from_arrays(rows, names=["conv_id", "digest", "key", "words"])

        for batch in batches:
            for c, ids, counts in zip(*(batch.column(x).to_pylist() for x in (0, 2, 3)), strict=True):
                if c != conv:
                    if conv is not None:
                        close()
                    conv, parts, words = c, [], []
                parts.append(ids)
                words += counts
            yield out()
        if conv is not None:
            close()
            yield out()

    kept = F.array_sort(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "id", "words"))))
    chunk = F.floor(F.coalesce("place", F.lit(0)) / chunk_turns).alias("chunk")
    chunks = turns.groupBy("conv_id", chunk).agg(kept.alias("kept")).select(
        "conv_id", "chunk", F.unhex(F.array_join(F.transform("kept", lambda t: F.hex(t["id"])), "")).alias("ids"),
        F.col("kept.words").alias("words"))
    dealt = chunks.repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "chunk")
    return dealt.mapInArrow(lean(run), "conv_id long, digest binary, key binary, words binary")


def _ends(convs: DataFrame, bucket_ids: int) -> DataFrame:
    """(digest, ends_sha256): of the ids of equal conversations, in ascending order, read as a stream.

    Ids are distinct, so a bucket of ids is bounded, and a very common conversation moves as one row per bucket.
    """
    def run(batches: Batches) -> Batches:
        digest, state, done = None, None, []

        def out():
            rows = [pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())]
            done.clear()
            return pa.RecordBatch.from_arrays(rows, names=["digest", "ends_sha256"])

        for batch in batches:
            for d, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if d != digest:
                    if digest is not None:
                        done.append((digest, state.hexdigest()))
                    digest, state = d, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield out()
        if digest is not None:
            done.append((digest, state.hexdigest()))
            yield out()

    listed = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    parts = convs.groupBy("digest", F.floor(F.col("conv_id") / bucket_ids).alias("bucket")).agg(listed.alias("ids"))
    rows = parts.repartition(partitions(convs.sparkSession), "digest").sortWithinPartitions("digest", "bucket")
    return rows.mapInArrow(lean(run), "digest binary, ends_sha256 string")


def _ranges(keys: DataFrame, range_bytes: int, range_keys: int) -> DataFrame:
    """The distinct keys, sorted, with the number of the range they stand in."""
    names = ["key", "words", "n", "least", "ends_sha256", "range"]

    def run(batches: Batches) -> Batches:
        number, size, rows = TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            given = []
            for length in pc.binary_length(batch.column(0)).to_pylist():
                if rows and (size >= range_bytes or rows >= range_keys):
                    number, size, rows = number + 1, 0, 0
                size, rows = size + length, rows + 1
                given.append(number)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(given, pa.int64())], names=names)

    rows = keys.select(*names[:-1]).repartitionByRange("key").sortWithinPartitions("key")
    return store(rows.mapInArrow(lean(run), "key binary, words binary, n long, least long, ends_sha256 string, range long"), "ranges")


def _borders(ranged: DataFrame) -> DataFrame:
    """(range, left, right): depths of the common prefixes with the keys before and after, -1 where there are none."""
    edges = ranged.groupBy("range").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    by_range = Window.orderBy("range")
    edges = edges.select("range", "first", "last", F.lag("last").over(by_range).alias("before"), F.lead("first").over(by_range).alias("after"))

    def run(batches: Batches) -> Batches:
        def depth(a, b):
            return -1 if a is None or b is None else _common(a, b) // WIDTH

        for batch in batches:
            number, first, last, before, after = (c.to_pylist() for c in batch.columns)
            yield pa.RecordBatch.from_arrays(
                [pa.array(number, pa.int64()), pa.array([depth(a, b) for a, b in zip(before, first, strict=True)], pa.int64()),
                 pa.array([depth(a, b) for a, b in zip(last, after, strict=True)], pa.int64())], names=["range", "left", "right"])

    return edges.mapInArrow(lean(run), "range long, left long, right long")


def trie(turns: DataFrame, range_bytes: int = RANGE_BYTES, range_keys: int = RANGE_KEYS, chunk_turns: int = CHUNK_TURNS,
         bucket_ids: int = BUCKET_IDS) -> DataFrame:
    """The nodes of the prefix trie of conversations given as (conv_id, place, id, words)."""
    convs = store(_keys(turns, chunk_turns), "conversation-keys")
    counted = convs.groupBy("digest").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"),
                                          F.any_value("key").alias("key"), F.any_value("words").alias("words"))
    ranged = _ranges(counted.join(_ends(convs, bucket_ids), "digest"), range_bytes, range_keys)

    def build(key, group: pa.Table, border: pa.Table) -> pa.Table:
        group = group.sort_by("key")
        words = [np.frombuffer(w, np.int32) for w in group.column("words").to_pylist()]
        rows = _range_nodes(group.column("key").to_pylist(), words, *(group.column(c).to_pylist() for c in ("n", "least", "ends_sha256")),
                            border.column("left")[0].as_py(), border.column("right")[0].as_py())
        return pa.Table.from_batches([_batch(rows)])

    borders = _borders(ranged)
    built = store(ranged.groupBy("range").cogroup(borders.groupBy("range")).applyInArrow(build, NODE), "trie")
    spine = built.filter("node IS NOT NULL").groupBy(F.lit(0).alias("all")).applyInArrow(
        lambda group: pa.Table.from_batches([_batch(_resolve([tuple(r.values()) for r in group.to_pylist()]))]), NODE)
    spine = store(spine, "spine")
    columns = _NAMES[:8]
    final = built.filter("node IS NULL")
    named = spine.select(F.col("node").alias("parent_node"), F.col("conv_id").alias("above"))
    hung = final.filter("parent_node IS NOT NULL").join(named, "parent_node").withColumn("parent_conv_id", F.col("above"))
    return (final.filter("parent_node IS NULL").select(*columns).unionByName(hung.select(*columns))
            .unionByName(spine.select(*columns)))


def conversation_trie(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of the rebuilt conversations of a table of turns."""
    return trie(store(rebuilt(ordered_turns(turns, conv_id, turn, role, text)), "rebuilt"))
