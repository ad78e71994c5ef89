"""Spelling variants: words one edit apart, found in a trie of letter-group counts.

A word's vector counts its letters by group (`GROUPS`, then all other letters). An edit adds at most one letter
to one group and takes at most one from another, so the vectors of two near words differ by a surplus and a
deficit of at most one each. Words are arranged as a trie by successive counts. A search goes down from the root
and spends the two budgets of one; the words it ends at are verified as exactly one edit away.

The trie is spread over Spark by its upper levels: a word lies in the shard of its first counts, a search goes to
all shards that its budgets reach. Shards of more than `SHARD_WORDS` words are cut at a deeper level, and those
that are still larger at full depth, or that many searches reach, are cut into blocks of words and of searches
which all meet. Each pair is searched from its lesser word (by vector, then word) only. Inside a task all
searches go down the trie together.

Counting is done in the tasks that read the texts, so a frequent word moves once per task. Counts above
`MOST` in a group stand for any larger one, which keeps every near pair.

A null text has no words; a null id is written as empty before the colon; repeated rows count each. An empty table
gives an empty result, and columns other than id and text are not read. Texts are taken whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwright.llm.common import Batches, lean, one_string_column, store

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LETTERS_LEAST, OCCURRENCES_LEAST, RATIO, DAMAGE = 6, 5, 5, 199
#: One level of the trie for each group, the frequent letters first.
GROUPS = ("e", "a", "i", "n", "r", "t", "s", "o", "l", "u", "dc", "mp", "gbh", "vwkz", "fjqxy")
LEVELS = len(GROUPS) + 1
MOST = 7
DEPTHS = (3, 8, LEVELS)
SHARD_WORDS, SHARD_SEARCHES = 20_000, 200_000
KEPT_RUNS = 300_000
CHARS_TOGETHER = 1 << 21
SHORT = 48
PAIRS_TOGETHER = 1 << 17

_STEP = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)


class _Runs(dict):
    """Numbers of the runs met, with the checksum and length of each."""

    def __init__(self):
        super().__init__()
        self.sums: list[int] = []
        self.sizes: list[int] = []

    def __missing__(self, run: str) -> int:
        raw = run.encode()
        number = self[run] = len(self.sums)
        self.sums.append(zlib.crc32(raw))
        self.sizes.append(len(raw))
        return number


def _moved(heads: np.ndarray, most: int) -> np.ndarray:
    """What the checksums of the heads add to that of a run of 0, 1, ... `most` bytes behind them."""
    out = np.zeros((len(heads), most + 1), np.uint32)
    out[:, 0] = heads
    for size in range(most):
        now = out[:, size]
        out[:, size + 1] = _STEP[now & np.uint32(255)] ^ (now >> np.uint32(8))
    return out


class _Counts:
    """Occurrences of the words of some texts, after the planned damage."""

    def __init__(self, damage: int):
        self.damage = damage
        self.clear()

    def clear(self) -> None:
        self.runs, self.counts, self.damaged = _Runs(), np.zeros(0, np.int64), Counter()

    def add(self, ids: list, texts: list[str]) -> None:
        found = [RUN.findall(t) for t in texts]
        sizes = [len(f) for f in found]
        flat = [run for f in found for run in f]
        number = np.fromiter(map(self.runs.__getitem__, flat), np.int64, len(flat))
        if len(self.counts) < len(self.runs):
            self.counts = np.concatenate([self.counts, np.zeros(len(self.runs) - len(self.counts) + 4096, np.int64)])
        if not len(flat):
            return
        heads = [f"{'' if i is None else i}:".encode() for i in ids]
        doc = np.repeat(np.arange(len(ids)), sizes)
        length = np.array(self.runs.sizes)[number]
        short = length <= 64
        table = _moved(np.array([zlib.crc32(h) for h in heads], np.uint32), 64)
        sums = np.array(self.runs.sums, np.uint32)[number] ^ table[doc, np.minimum(length, 64)]
        for at in np.flatnonzero(~short).tolist():
            sums[at] = zlib.crc32(heads[doc[at]] + flat[at].encode())
        hit = sums % np.uint32(self.damage) == 0
        self.counts += np.bincount(number[~hit], minlength=len(self.counts))
        for at in np.flatnonzero(hit).tolist():
            run, spot = flat[at], int(sums[at]) % len(flat[at])
            self.damaged[run[:spot] + run[spot + 1:]] += 1

    def rows(self, least: int) -> pa.RecordBatch:
        words, numbers = [], []
        counts = self.counts[:len(self.runs)].tolist()
        for word, n in zip(self.runs, counts, strict=True):
            if n and len(word) >= least:
                words.append(word)
                numbers.append(n)
        for word, n in self.damaged.items():
            if len(word) >= least:
                words.append(word)
                numbers.append(n)
        self.clear()
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(numbers, pa.int64())], names=["word", "n"])


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", letters: int = LETTERS_LEAST,
               occurrences: int = OCCURRENCES_LEAST, damage: int = DAMAGE) -> DataFrame:
    """(word, n): the words of enough letters that occur often enough in all texts."""
    def run(batches: Batches) -> Batches:
        counts = _Counts(damage)
        for batch in batches:
            ids, held, size = batch.column(0).to_pylist(), [], 0
            first = 0
            for at, raw in enumerate(batch.column(1).cast(pa.binary()).to_pylist()):
                held.append(raw.lower().decode("utf-8", "replace"))
                size += len(raw)
                if size >= CHARS_TOGETHER:
                    counts.add(ids[first:at + 1], held)
                    first, held, size = at + 1, [], 0
                    if len(counts.runs) > KEPT_RUNS:
                        yield counts.rows(letters)
            counts.add(ids[first:], held)
            if len(counts.runs) > KEPT_RUNS:
                yield counts.rows(letters)
        yield counts.rows(letters)

    rows = docs.select(docs[doc_id].alias("doc_id"), one_string_column(docs, text))
    counted = rows.mapInArrow(lean(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= occurrences)


def with_vectors(words: DataFrame) -> DataFrame:
    """Adds `vec`, one digit per level of the trie."""
    counts = [F.length("word") - F.length(F.translate("word", g, "")) for g in GROUPS]
    rest = F.length(F.translate("word", "".join(GROUPS), ""))
    digits = [F.least(c, F.lit(MOST)).cast("string") for c in [*counts, rest]]
    return words.withColumn("vec", F.concat(*digits))


def reached(own: str, key: str, depth: int) -> list[str]:
    """The trie nodes at a depth below the node `key` that the vector `own` reaches and that are not before its own."""
    spent = [0, 0]
    for a, b in zip(own, key, strict=False):
        spent[a > b] += abs(int(a) - int(b))
    found = [(key, *spent)]
    for level in range(len(key), depth):
        value, now = int(own[level]), []
        for node, surplus, deficit in found:
            now.append((node + own[level], surplus, deficit))
            if not surplus and value < MOST:
                now.append((node + str(value + 1), 1, deficit))
            if not deficit and value:
                now.append((node + str(value - 1), surplus, 1))
        found = now
    return [node for node, _, _ in found if node >= own[:depth]]


def _opened(rows: DataFrame, depth: int) -> DataFrame:
    """Searches (word, n, vec, node) carried to all nodes at a depth that they reach."""
    def run(batches: Batches) -> Batches:
        for batch in batches:
            vecs, nodes = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            found = [reached(v, k, depth) for v, k in zip(vecs, nodes, strict=True)]
            take = np.repeat(np.arange(len(found)), [len(f) for f in found])
            kept = batch.take(pa.array(take))
            yield pa.RecordBatch.from_arrays([*kept.columns[:3], pa.array([k for f in found for k in f], pa.string())],
                                             names=["word", "n", "vec", "node"])

    return rows.select("word", "n", "vec", "node").mapInArrow(lean(run), "word string, n long, vec string, node string")


def _sharded(words: DataFrame, shard_words: int) -> tuple[DataFrame, DataFrame]:
    """The words with the node that is their shard, and the searches with the nodes they go to.

    Searches are stored at each depth: both those that stay there and those that go deeper read them.
    """
    placed, searches, left, open_ = [], [], words, words.withColumn("node", F.lit(""))
    columns = ["node", "word", "n", "vec"]
    for depth in DEPTHS:
        left = left.withColumn("node", F.substring("vec", 1, depth))
        most = shard_words if depth < LEVELS else None
        nodes = left.groupBy("node").agg((F.count("*") > most if most else F.lit(False)).alias("cut"))
        nodes = store(nodes, "trie-nodes")
        open_ = store(_opened(open_, depth).join(nodes, "node"), "trie-searches")
        here = left.join(nodes, "node")
        placed.append(here.filter("NOT cut").select(*columns))
        searches.append(open_.filter("NOT cut").select(*columns))
        if nodes.filter("cut").isEmpty():
            break
        left, open_ = here.filter("cut").drop("cut"), open_.filter("cut").drop("cut")
    return reduce(DataFrame.unionByName, placed), reduce(DataFrame.unionByName, searches)


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point lies between two different words."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    n, m = min(len(a), len(b)), max(len(a), len(b))
    head = next((i for i in range(n) if a[i] != b[i]), n)
    tail = next((i for i in range(n) if a[-1 - i] != b[-1 - i]), n)
    return head + tail >= m - 1


class _Words:
    """Words of one task as matrices of counts and of code points from both ends."""

    def __init__(self, words: list[str], n: list[int], vecs: list[str]):
        self.words, self.n = words, n
        self.counts = np.frombuffer("".join(vecs).encode(), np.uint8).reshape(-1, LEVELS).astype(np.int8) - 48
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.width = int(min(SHORT, self.sizes.max(initial=1)))
        cut = [w if len(w) <= SHORT else "" for w in words]
        self.left = self._codes([w.ljust(self.width, "\0") for w in cut])
        self.right = self._codes([w.rjust(self.width, "\0")[::-1] for w in cut])

    def _codes(self, padded: list[str]) -> np.ndarray:
        return np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32).reshape(-1, self.width)


def _near(words: _Words, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the candidate pairs are one edit apart: equal heads and tails cover all but one letter."""
    sizes = np.maximum(words.sizes[a], words.sizes[b])
    near = np.abs(words.sizes[a] - words.sizes[b]) <= 1
    a, b, held = a[near], b[near], np.flatnonzero(near)
    head = (words.left[a] != words.left[b]).argmax(axis=1)
    tail = (words.right[a] != words.right[b]).argmax(axis=1)
    ok = head + tail >= sizes[held] - 1
    for i in np.flatnonzero(sizes[held] > SHORT).tolist():
        ok[i] = one_edit(words.words[a[i]], words.words[b[i]])
    near[held] = ok
    return near


def _descend(counts: np.ndarray, order: np.ndarray, stored: np.ndarray, asked: np.ndarray, few: int = 8):
    """Candidate pairs (asked, stored) by a descent of all searches together; `order` ranks words by vector, then text."""
    stored = stored[np.argsort(order[stored])]
    none = np.zeros(len(asked), np.int8)
    stack = [(0, len(stored), 0, asked, none, none)]
    while stack:
        low, high, level, asks, surplus, deficit = stack.pop()
        if high - low <= few or level == LEVELS:
            for begin in range(low, high, few):
                at = stored[begin:min(begin + few, high)]
                diff = counts[at][None, :, level:] - counts[asks][:, None, level:]
                over = np.where(diff > 0, diff, 0).sum(axis=2) + surplus[:, None]
                under = np.where(diff < 0, -diff, 0).sum(axis=2) + deficit[:, None]
                ask, word = np.nonzero((over <= 1) & (under <= 1) & (order[at][None, :] > order[asks][:, None]))
                if len(ask):
                    yield asks[ask], at[word]
            continue
        column, own = counts[stored[low:high], level], counts[asks, level]
        edges = [0, *(np.flatnonzero(np.diff(column)) + 1).tolist(), high - low]
        for first, last in zip(edges, edges[1:], strict=False):
            diff = column[first] - own
            over, under = surplus + np.maximum(diff, 0), deficit + np.maximum(-diff, 0)
            kept = np.flatnonzero((over <= 1) & (under <= 1))
            if len(kept):
                stack.append((low + first, low + last, level + 1, asks[kept], over[kept], under[kept]))


def _search(group: pa.Table) -> pa.Table:
    """All near pairs between the stored words and the searches of one block."""
    listed = group.column("word").to_pylist()
    names, first, number = np.unique(np.array(listed, object), return_index=True, return_inverse=True)
    vecs = group.column("vec").to_pylist()
    n = group.column("n").to_pylist()
    words = _Words([listed[i] for i in first], [n[i] for i in first], [vecs[i] for i in first])
    asks = group.column("asks").to_numpy(zero_copy_only=False).astype(bool)
    order = np.empty(len(names), np.int64)
    keys = [words.counts[:, level] for level in reversed(range(LEVELS))]
    order[np.lexsort([np.arange(len(names)), *keys])] = np.arange(len(names))
    pairs, held = [], []

    def verify():
        if held:
            a, b = (np.concatenate(x) for x in zip(*held, strict=True))
            near = _near(words, a, b)
            pairs.append((a[near], b[near]))
            held.clear()

    size = 0
    for a, b in _descend(words.counts, order, number[~asks], number[asks]):
        held.append((a, b))
        size += len(a)
        if size >= PAIRS_TOGETHER:
            verify()
            size = 0
    verify()
    a, b = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, int), np.zeros(0, int))
    listed_n = np.array(words.n, np.int64)
    texts = pa.array(words.words, pa.string())
    return pa.table({"a": texts.take(pa.array(a)), "n_a": listed_n[a], "b": texts.take(pa.array(b)), "n_b": listed_n[b]})


def near_pairs(words: DataFrame, shard_words: int = SHARD_WORDS, shard_searches: int = SHARD_SEARCHES) -> DataFrame:
    """(a, n_a, b, n_b): all pairs of words one edit apart, each once. `words` has distinct (word, n)."""
    words = store(with_vectors(words.select("word", "n")), "word-vectors")
    placed, searches = _sharded(words, shard_words)
    placed = store(placed, "trie-words")
    blocks = placed.groupBy("node").agg(F.ceil(F.count("*") / shard_words).alias("word_blocks"))
    asked = searches.groupBy("node").agg(F.ceil(F.count("*") / shard_searches).alias("ask_blocks"))
    shape = blocks.join(asked, "node")

    def dealt(rows: DataFrame, own: str, other: str, own_at: str, other_at: str, asks: bool) -> DataFrame:
        rows = rows.join(shape, "node").withColumn(own_at, F.pmod(F.xxhash64("word"), F.col(own)))
        rows = rows.withColumn(other_at, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
        return rows.select("node", "at_words", "at_asks", "word", "n", "vec", F.lit(asks).alias("asks"))

    both = dealt(placed, "word_blocks", "ask_blocks", "at_words", "at_asks", False).unionByName(
        dealt(searches, "ask_blocks", "word_blocks", "at_asks", "at_words", True))
    return both.groupBy("node", "at_words", "at_asks").applyInArrow(
        lambda key, group: _search(group), "a string, n_a long, b string, n_b long")


def spelling_groups(words: DataFrame, ratio: int = RATIO, shard_words: int = SHARD_WORDS,
                    shard_searches: int = SHARD_SEARCHES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for a stored table of distinct (word, n).

    A word's form is its near word of largest n, the first in code-point order among equals, if that n is at
    least `ratio` times its own; the root is where the forms end.
    """
    pairs = near_pairs(words, shard_words, shard_searches)
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("n_b").alias("m"), F.col("b").alias("other")),
        F.struct(F.col("b").alias("word"), F.col("n_a").alias("m"), F.col("a").alias("other")))).alias("p")).select("p.*")
    best = both.groupBy("word").agg(
        F.count("*").alias("n_near"),
        F.min(F.struct((-F.col("m")).alias("less"), F.col("other"))).alias("best"))
    best = best.select("word", "n_near", F.col("best.other").alias("other"), (-F.col("best.less")).alias("m"))
    chosen = F.col("m") >= ratio * F.col("n")
    formed = store(words.select("word", "n").join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(chosen, F.col("other")).alias("form"), F.when(chosen, F.col("m")).alias("form_n")), "forms")
    ends = roots(formed.filter("form IS NOT NULL").select("word", F.col("form").alias("root")))
    joined = formed.join(ends, "word", "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(links: DataFrame) -> DataFrame:
    """(word, root) after following the links to their ends, twice as far each round; counts rise, so there are few."""
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = store(links.join(ahead, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        links = further.select("word", "root")
        if further.filter("moved").isEmpty():
            return links


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`spelling_groups` of the vocabulary of all texts."""
    return spelling_groups(store(vocabulary(docs, doc_id, text), "vocabulary"))
