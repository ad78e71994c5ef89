"""Near-duplicate groups by an exact Jaccard self-join with adaptive multi-match prefixes.

A document is the set of its word shingles, hashed to 64 bits. Documents with equal sets form a class; one
row of each class goes on. Shingles are counted over all classes, summed per block of documents first and
returned to the blocks only where a shingle stands in two classes or more. Every class orders its shingles
from the rarest on. With threshold t and n shingles, two classes that are similar enough share at least m of
the first n - ceil(t n) + m, for every m. Each class lengthens its prefix to the m (up to `MOST_MATCHES`)
whose estimated cost is least: the postings read, plus the candidates they can make at m matches each, times
the cost of a verification. Two classes are verified only if they share min(m, m') prefix shingles. A class
whose shortest prefix holds only shingles of its own has no partner and drops out.

No list is paired out: within a posting list every class is first checked against the list's first class,
and only classes that are then in different components are checked further, block against block within a
task, so that neither pairs of linked copies nor candidate pairs become rows. That search gives the component
ids. The links themselves come from `linked_classes`: the lists that have the same first class are one star, a
star's classes are compared block against block, each pair in the least of the stars that hold both, so that
every pair of classes with shared prefix shingles is verified once. `similar_pairs` gives the links, and
`near_groups` their number for each class on request.

Words are runs of non-blanks with A-Z folded; a text of fewer words than a shingle is one shingle. Null and
empty texts have no shingles and are linked with nothing. Rows that repeat an id are rows of their own; a
null id never becomes a component's name while a member has one. Empty tables give empty results. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwright.llm.common import (Batches, give_back, lean, mix64, one_string_column, partitions, set_aside, slices,
                                    span_hashes, store, texts_of, word_spans)

MOST_MATCHES = 8
VERIFY_COST = 50
BLOCK_TOKENS = 1_000_000
GROUP_BLOCK = 256
LINK_BLOCK = 256
LINK_ROWS = 1 << 16
HUB_SHARE = 500
CHUNK = 1 << 22

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of every word."""
    out = [np.zeros(0, np.uint64)]
    for part in slices(text.lower(), _SPACE, CHUNK):
        raw = np.frombuffer(part, np.uint8)
        out.append(span_hashes(raw, *word_spans(raw, _SPACE)))
    return np.concatenate(out)


def shingles(text: bytes, size: int) -> np.ndarray:
    """The sorted distinct shingles of a text."""
    words = word_hashes(text)
    if not len(words):
        return words
    width = min(size, len(words))
    state = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        state = mix64(state ^ words[k:len(words) - width + 1 + k], 23)
    return np.unique(state)


def set_hash(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def least_overlap(n, percent: int):
    """ceil(percent n / 100): a partner of a set of n shares at least so many of them."""
    return -(-percent * n // 100)


def similar(both, n, m, percent: int):
    return 100 * both >= percent * (n + m - both)


# --- classes and shingle counts ----------------------------------------------------------------------------

def signatures(docs: DataFrame, size: int) -> DataFrame:
    """Rows (doc_id, n_shingles, set_hash, text_sha256)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Batches) -> Batches:
        for batch in batches:
            texts = texts_of(batch.column(1))
            sets = [shingles(t, size) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([set_hash(s) for s in sets], pa.binary()),
                 pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())],
                names=["doc_id", "n_shingles", "set_hash", "text_sha256"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, n_shingles long, set_hash binary, text_sha256 binary")


def _block(doc_id, text_sha256, blocks: int):
    """Rows without an id, or with a repeated one, are dealt by their texts."""
    return F.pmod(F.xxhash64(doc_id, text_sha256), F.lit(blocks)).cast("int")


def _sets_of(left: pa.Table, right: pa.Table, size: int) -> list[tuple[int, np.ndarray]]:
    """(class_id, shingles) of one row of each class that is at home in this block."""
    open_ = {}
    for ids, hashes in zip(right["class_ids"].to_pylist(), right["hashes"].to_pylist(), strict=True):
        open_ |= dict(zip(hashes or (), ids or (), strict=True))
    out = []
    if open_:
        for text in texts_of(left["text"].combine_chunks()):
            tokens = shingles(text, size)
            found = open_.pop(set_hash(tokens), None)
            if found is not None:
                out.append((found, tokens))
    return out


def _pack(sorted_values: np.ndarray) -> bytes:
    """Gaps of sorted 48-bit values, in four bytes each where they fit."""
    gaps = np.diff(sorted_values, prepend=np.uint64(0))
    small = not len(gaps) or not (gaps[1:] >> np.uint64(32)).any()
    head = sorted_values[:1].astype("<u8").tobytes()
    return (b"4" if small else b"8") + head + gaps[1:].astype("<u4" if small else "<u8").tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    gaps = np.frombuffer(raw, "<u4" if raw[:1] == b"4" else "<u8", offset=9).astype(np.uint64)
    return np.cumsum(np.concatenate([np.frombuffer(raw, "<u8", 1, 1), gaps]), dtype=np.uint64)


def _short(tokens: np.ndarray) -> np.ndarray:
    """Shingles are counted by 48 bits; a rare clash only makes one look more frequent."""
    return tokens >> np.uint64(16)


def frequencies(homes: DataFrame, members: DataFrame, size: int, ranges_: int) -> DataFrame:
    """(block, tokens, counts) of the shingles that stand in two classes or more, for each block."""

    def local(left: pa.Table, right: pa.Table) -> pa.Table:
        sets = _sets_of(left, right, size)
        values, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *(_short(t) for _, t in sets)]), return_counts=True)
        part = ((values >> np.uint64(16)) * np.uint64(ranges_) >> np.uint64(32)).astype(np.int64)
        edges = np.searchsorted(part, np.arange(ranges_ + 1))
        rows = [(p, a, b) for p, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
        give_back()
        return pa.table({
            "part": pa.array([r[0] for r in rows], pa.int32()),
            "block": pa.array([left["block"][0].as_py() if left.num_rows else 0] * len(rows), pa.int32()),
            "tokens": pa.array([_pack(values[a:b]) for _, a, b in rows], pa.binary()),
            "counts": pa.array([counts[a:b].astype("<u4").tobytes() for _, a, b in rows], pa.binary())})

    def total(table: pa.Table) -> pa.Table:
        blocks, lists = table["block"].to_pylist(), [_unpack(t) for t in table["tokens"].to_pylist()]
        counts = np.concatenate([np.frombuffer(c, "<u4") for c in table["counts"].to_pylist()])
        values, place = np.unique(np.concatenate(lists), return_inverse=True)
        sums = np.bincount(place, counts, minlength=len(values)).astype(np.int64)[place]
        rows, at = [], 0
        for block, values in zip(blocks, lists, strict=True):
            own = sums[at:at + len(values)]
            at += len(values)
            if (own > 1).any():
                rows.append((block, _pack(values[own > 1]), own[own > 1].astype("<u4").tobytes()))
        return pa.table({"block": pa.array([r[0] for r in rows], pa.int32()),
                         "tokens": pa.array([r[1] for r in rows], pa.binary()),
                         "counts": pa.array([r[2] for r in rows], pa.binary())})

    cells = homes.groupBy("block").cogroup(members.groupBy("block")).applyInArrow(
        local, "part int, block int, tokens binary, counts binary")
    return cells.groupBy("part").applyInArrow(total, "block int, tokens binary, counts binary")


def choose_matches(excess: np.ndarray, base: int, most: int) -> int:
    """How many shared shingles to ask for: the least cost over the prefixes of base + m shingles.

    excess: other classes that hold each shingle, from the rarest on. Of k postings at most k / m classes
    appear m times.
    """
    postings = np.cumsum(excess)[base:base + most]
    m = np.arange(1, len(postings) + 1)
    return int(np.argmin(postings + VERIFY_COST * postings / m)) + 1


def live_classes(homes: DataFrame, members: DataFrame, counted: DataFrame, size: int, percent: int) -> DataFrame:
    """(class_id, n, own, matches, prefix, tokens) of the classes that may have a partner."""
    no_members = F.lit(None).cast("array<long>").alias("class_ids"), F.lit(None).cast("array<binary>").alias("hashes")
    nothing = F.lit(None).cast("binary")
    right = (members.select("block", "class_ids", "hashes", nothing.alias("tokens"), nothing.alias("counts"))
             .unionByName(counted.select("block", *no_members, "tokens", "counts")))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        sets = _sets_of(left, right, size)
        cells = sorted(((_unpack(t), np.frombuffer(c, "<u4")) for t, c in zip(
            right["tokens"].to_pylist(), right["counts"].to_pylist(), strict=True) if t), key=lambda x: x[0][0])
        known = np.concatenate([*(c[0] for c in cells), np.zeros(1, np.uint64)])
        often = np.concatenate([*(c[1] for c in cells), np.ones(1, np.uint32)]).astype(np.int64)
        rows = []
        for class_id, tokens in sets:
            short = _short(tokens)
            at = np.searchsorted(known[:-1], short)
            counts = np.where(known[at] == short, often[at], 1)
            order = np.lexsort((tokens, counts))
            need = least_overlap(len(tokens), percent)
            base, excess = len(tokens) - need, counts[order] - 1
            if not excess[:base + 1].any():
                continue
            matches = choose_matches(excess, base, min(MOST_MATCHES, need))
            prefix = tokens[order[:base + matches]][excess[:base + matches] > 0]
            rows.append((class_id, len(tokens), int((counts == 1).sum()), matches, prefix.view(np.int64).tolist(),
                         tokens.tobytes()))
        give_back()
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary())
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                        names=["class_id", "n", "own", "matches", "prefix", "tokens"])

    return homes.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(
        run, "class_id long, n long, own long, matches int, prefix array<long>, tokens binary")


# --- verification ------------------------------------------------------------------------------------------

class _Member:
    __slots__ = ("id", "n", "own", "matches", "prefix", "tokens", "component")

    def __init__(self, id_, n, own, matches, prefix, tokens, component=None):
        self.id, self.n, self.own, self.matches, self.component = id_, n, own, matches, component
        self.prefix = np.sort(np.array(prefix, np.int64).view(np.uint64))
        self.tokens = np.frombuffer(tokens, np.uint64)


def _shared(one: np.ndarray, lists: list[np.ndarray]) -> np.ndarray:
    """How many values of a sorted list stand in each of the others."""
    flat = np.concatenate(lists)
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])[:-1]])
    return np.add.reduceat((one[at] == flat).astype(np.int64), starts)


def partners(one: _Member, others: list[_Member], percent: int) -> list[_Member]:
    """Those of the others that are similar to one."""
    return [o for o, _ in partners_shared(one, others, percent)]


def partners_shared(one: _Member, others: list[_Member], percent: int) -> list[tuple[_Member, int]]:
    """The partners of one and how many shingles they share: size, then multi-match, then the whole sets."""
    # Shingles that no other class holds cannot be shared.
    others = [o for o in others if similar(min(one.n - one.own, o.n - o.own), one.n, o.n, percent)]
    if not others:
        return []
    hits = _shared(one.prefix, [o.prefix for o in others])
    others = [o for o, k in zip(others, hits.tolist(), strict=True) if k >= min(one.matches, o.matches)]
    if not others:
        return []
    both = _shared(one.tokens, [o.tokens for o in others])
    return [(o, k) for o, k in zip(others, both.tolist(), strict=True) if similar(k, one.n, o.n, percent)]


_CARRIED = ("n", "own", "matches", "prefix", "tokens")


def verify_stars(live: DataFrame, stars: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs (class_id, hub) that are similar. A hub's members are read as a stream after it."""
    degrees = store(stars.groupBy("hub").agg((1 + F.count(F.lit(1)) / HUB_SHARE).cast("int").alias("salts")), "hubs")
    pairs = stars.join(degrees, "hub").withColumn("salt", F.pmod(F.xxhash64("class_id"), F.col("salts")).cast("int"))
    members = pairs.select("hub", "salt", "class_id").join(live, "class_id").withColumn("is_member", F.lit(True))
    heads = (degrees.select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
             .join(live, F.col("hub") == F.col("class_id")).withColumn("is_member", F.lit(False)))
    fields = ["hub", "salt", "is_member", "class_id", *_CARRIED]
    rows = heads.select(*fields).unionByName(members.select(*fields))

    def run(batches: Batches) -> Batches:
        hub = None
        for batch in batches:
            found = []
            for _, _, is_member, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                member = _Member(*values)
                if not is_member:
                    hub = member
                elif partners(hub, [member], percent):
                    found.append((hub.id, member.id))
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(2)], names=["a", "b"])

    dealt = rows.repartition(partitions(live.sparkSession), "hub", "salt").sortWithinPartitions("hub", "salt", "is_member")
    return dealt.mapInArrow(lean(run), "a long, b long")


def verify_groups(live: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(a, b) of similar classes of a group that join its components.

    groups: (class_id, group, component). A group is cut into blocks; a task compares two blocks and
    gives as many links as join what is connected there, not all that it finds.
    """
    sizes = store(groups.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / GROUP_BLOCK).cast("int").alias("blocks")), "groups")
    rows = groups.join(sizes, "group").join(live, "class_id")
    rows = rows.withColumn("own_block", F.pmod(F.xxhash64("class_id", F.lit(1)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("group", F.least("own_block", "other").alias("low"), F.greatest("own_block", "other").alias("high"),
                       "own_block", "class_id", *_CARRIED, "component")

    def run(batches: Batches) -> Batches:
        key, sides, found = None, {}, []

        def compare():
            low, high = key[1], key[2]
            first = sides.get(low, [])
            joined: dict[int, int] = {}

            def root(c: int) -> int:
                while (up := joined.get(c, c)) != c:
                    joined[c] = joined.get(up, up)
                    c = up
                return c

            # What this task has already joined needs no further link: one per component at most.
            for i, one in enumerate(first):
                rest = first[i + 1:] if low == high else sides.get(high, [])
                own = root(one.component)
                others = [o for o in rest if root(o.component) != own]
                for other in partners(one, others, percent):
                    a, b = root(one.component), root(other.component)
                    if a != b:
                        joined[max(a, b)] = min(a, b)
                        found.append((one.id, other.id))

        def out():
            rows = pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(2)], names=["a", "b"])
            found.clear()
            return rows

        for batch in batches:
            for group, low, high, block, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != (group, low, high):
                    if key is not None:
                        compare()
                    key, sides = (group, low, high), {}
                sides.setdefault(block, []).append(_Member(*values))
            yield out()
        if key is not None:
            compare()
            yield out()

    dealt = rows.repartition(partitions(live.sparkSession), "group", "low", "high").sortWithinPartitions("group", "low", "high")
    return dealt.mapInArrow(lean(run), "a long, b long")


def linked_classes(live: DataFrame, percent: int, counted: bool) -> DataFrame:
    """Every link between classes, once: (a, b, both) with a < b, or, counted, (class_id, n_links)."""
    postings = store(live.select("class_id", "n", F.explode("prefix").alias("token")), "link-prefixes")
    hubs = postings.groupBy("token").agg(F.min("class_id").alias("hub"), F.count(F.lit(1)).alias("held")).filter("held > 1")
    stars = store(postings.join(hubs.select("token", "hub"), "token").select("class_id", "n", "hub").distinct(), "link-stars")
    size = F.greatest(F.count(F.lit(1)) / LINK_BLOCK, F.sum("n") / BLOCK_TOKENS)
    sizes = store(stars.groupBy("hub").agg(F.ceil(size).cast("int").alias("blocks")), "link-blocks")
    # A pair that shares several stars belongs to the least of them.
    of_class = store(stars.groupBy("class_id").agg(F.collect_set("hub").alias("hubs")).join(live, "class_id")
                     .select("class_id", *_CARRIED, "hubs"), "link-classes")
    rows = stars.select("class_id", "hub").join(sizes, "hub").join(of_class, "class_id")
    rows = rows.withColumn("hubs", F.expr("filter(hubs, h -> h < hub)"))
    rows = rows.withColumn("own_block", F.pmod(F.xxhash64("class_id", F.lit(1)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("hub", F.least("own_block", "other").alias("low"), F.greatest("own_block", "other").alias("high"),
                       "own_block", "class_id", *_CARRIED, "hubs")

    def links(low: int, high: int, sides: dict[int, list[_Member]]):
        for i, one in enumerate(sides.get(low, [])):
            rest = sides[low][i + 1:] if low == high else sides.get(high, [])
            here = [o for o in rest if one.component.isdisjoint(o.component)]
            for other, both in partners_shared(one, here, percent):
                yield min(one.id, other.id), max(one.id, other.id), both

    def run(batches: Batches) -> Batches:
        def stars_of():
            key, sides = None, {}
            for batch in batches:
                for hub, low, high, block, *values, lower in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if key != (hub, low, high):
                        if key is not None:
                            yield from links(*key[1:], sides)
                        key, sides = (hub, low, high), {}
                    sides.setdefault(block, []).append(_Member(*values, frozenset(lower)))
            if key is not None:
                yield from links(*key[1:], sides)

        found = stars_of()
        while part := list(islice(found, LINK_ROWS)):
            columns = np.array(part, np.int64).T
            if counted:
                ids, times = np.unique(columns[:2], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(times)], names=["class_id", "n_links"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "both"])

    dealt = rows.repartition(partitions(live.sparkSession), "hub", "low", "high").sortWithinPartitions("hub", "low", "high")
    if not counted:
        return dealt.mapInArrow(lean(run), "a long, b long, both long")
    return dealt.mapInArrow(lean(run), "class_id long, n_links long").groupBy("class_id").agg(F.sum("n_links").alias("n_links"))


# --- components --------------------------------------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node reaches, by neighbours' labels and pointer jumping."""
    both = store(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
                 "edges")
    labels = store(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    while True:
        known = labels.withColumnRenamed("node", "b")
        near = both.join(known, "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        met = store(labels.join(near, "node").select(
            "node", F.col("component").alias("old"), F.least("component", "near").alias("component")), "labels")
        jump = met.select(F.col("node").alias("component"), F.col("component").alias("further"))
        moved = store(met.join(jump, "component").select("node", "old", F.least("component", "further").alias("component")),
                      "labels")
        labels = moved.select("node", "component")
        if moved.filter("component <> old").isEmpty():
            return labels


def similar_components(live: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the classes that are linked with another."""
    postings = store(live.select("class_id", F.explode("prefix").alias("token")), "prefixes")
    hubs = store(postings.groupBy("token").agg(F.min("class_id").alias("hub"), F.count(F.lit(1)).alias("held"))
                 .filter("held > 1").select("token", "hub"), "hubs")
    stars = store(postings.join(hubs, "token").filter("class_id <> hub").select("token", "class_id", "hub"), "stars")
    links = store(verify_stars(live, stars.select("class_id", "hub").distinct(), percent), "links")
    linked = components(links)
    # Lists whose classes are now in one component are done with.
    named = linked.withColumnRenamed("node", "class_id")
    of_hub = linked.select(F.col("node").alias("hub"), F.col("component").alias("hub_component"))
    apart = (stars.select("class_id", "hub").distinct().join(named, "class_id", "left").join(of_hub, "hub", "left")
             .filter(F.coalesce("component", "class_id") != F.coalesce("hub_component", "hub")))
    open_hubs = store(apart.select("hub").distinct(), "open-hubs")
    open_lists = stars.select("class_id", "hub").distinct().join(open_hubs, "hub", "left_semi")
    groups = components(store(open_lists.select(F.col("class_id").alias("a"), F.col("hub").alias("b")), "open-lists"))
    rows = (groups.select(F.col("node").alias("class_id"), F.col("component").alias("group")).join(named, "class_id", "left")
            .select("class_id", "group", F.coalesce("component", "class_id").alias("component")))
    more = verify_groups(live, store(rows, "open-groups"), percent)
    return components(store(links.unionByName(more), "links"))


def _searched(docs: DataFrame, size: int, percent: int, text: str, doc_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored rows (doc_id, n_shingles, set_hash, text_sha256), classes, and the classes that may have a partner."""
    rows = docs.select(docs[doc_id].alias("doc_id"), one_string_column(docs, text))
    signed = store(signatures(rows, size), "signatures")
    classes = (signed.filter("n_shingles > 0").groupBy("set_hash")
               .agg(F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "text_sha256")).alias("home"),
                    F.max("n_shingles").alias("n")))
    classes = store(classes.withColumn("class_id", F.monotonically_increasing_id()), "classes")
    # Blocks hold all rows, copies too, so they follow the rows' shingles and not the classes'.
    total = signed.agg(F.sum("n_shingles")).first()[0] or 0
    blocks = max(partitions(docs.sparkSession), -(-total // BLOCK_TOKENS))
    members = (classes.groupBy(_block(F.col("home.doc_id"), F.col("home.text_sha256"), blocks).alias("block"))
               .agg(F.collect_list("class_id").alias("class_ids"), F.collect_list("set_hash").alias("hashes")))
    # One row of each text is enough of those without an id.
    unnamed = rows.filter("doc_id IS NULL").dropDuplicates(["text"])
    homes = rows.filter("doc_id IS NOT NULL").unionByName(unnamed).select(
        _block(F.col("doc_id"), F.unhex(F.sha2("text", 256)), blocks).alias("block"), "text")
    counted = frequencies(homes, members, size, blocks)
    return signed, classes, store(live_classes(homes, members, counted, size, percent), "live")


def _named(classes: DataFrame, live: DataFrame, percent: int) -> DataFrame:
    """(set_hash, class_id, component, component_id) of the classes."""
    found = similar_components(live, percent)
    named = store(classes.join(found, classes["class_id"] == found["node"], "left").select(
        "set_hash", "class_id", "first", F.coalesce("component", "class_id").alias("component")), "named")
    least = store(named.groupBy("component").agg(F.min("first").alias("component_id")), "first-members")
    return named.join(least, "component").select("set_hash", "class_id", "component", "component_id")


def near_groups(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id",
                links: bool = False) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least doc_id it reaches by links), class_id.

    With `links` also n_links: the other classes that its class is similar to, all of them.
    """
    signed, classes, live = _searched(docs, size, percent, text, doc_id)
    named = _named(classes, live, percent).drop("component")
    if links:
        counts = store(linked_classes(live, percent, counted=True), "link-counts")
        named = named.join(counts, "class_id", "left")
    named = store(named, "named")
    return signed.join(named, "set_hash", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias(
            "component_id"), "class_id", *([F.coalesce("n_links", F.lit(0)).alias("n_links")] if links else []))


def similar_pairs(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text",
                  doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, n_shingles, class_id) and all links (a, b, both) between classes, a < b, each once.

    both: the shingles that the classes share. Documents of one class have equal sets; a document without
    shingles has no class.
    """
    signed, classes, live = _searched(docs, size, percent, text, doc_id)
    members = signed.join(classes.select("set_hash", "class_id"), "set_hash", "left")
    return members.select("doc_id", "n_shingles", "class_id"), store(linked_classes(live, percent, counted=False), "pairs")


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each group, with all its columns: the one of the least id, of rows without an id if there is no other.

    Rows are told apart by id and text, not by id alone; of rows equal in both one stays. Rows without words
    are in no group and all stay.
    """
    signed, classes, live = _searched(docs, size, percent, text, doc_id)
    named = store(_named(classes, live, percent).select("set_hash", "component"), "named")
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_sha256")
    kept = store(signed.join(named, "set_hash").groupBy("component").agg(F.min(first).alias("first")).select(
        _row_key(F.col("first.doc_id"), F.lower(F.hex("first.text_sha256"))).alias("row_key")), "kept")
    held, names = set_aside(docs)
    own = F.coalesce(F.col(names[text]).cast("string"), F.lit(""))
    has_words = own.rlike("[^\\x20\\x09-\\x0D]")
    rows = held.filter(has_words).withColumn("row_key", _row_key(F.col(names[doc_id]), F.sha2(own, 256)))
    # Joined by one column, so that rows that are equal in id and text are together already.
    rows = rows.join(kept, "row_key", "left_semi").dropDuplicates(["row_key"]).drop("row_key")
    return rows.unionByName(held.filter(~has_words)).select(*(F.col(n).alias(c) for c, n in names.items()))


def _row_key(doc_id, sha256):
    return F.concat(sha256, F.coalesce(F.concat(F.lit("="), doc_id.cast("string")), F.lit("")))
