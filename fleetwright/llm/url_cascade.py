"""URL rules by Bloom filter cascades: exact membership over the corpus's keys, without joins.

A rule names a host (with its subdomains) and a path prefix. The keys a URL could match are its host's label
suffixes joined with prefixes of its path, in the lengths that rules have. The distinct keys of all URLs are
the universe. For each verdict a cascade is built: level 0 is a Bloom filter of the listed keys, level 1 one
of the universe's keys that pass level 0 wrongly, level 2 one of the listed keys that pass level 1, and so
on until nothing passes wrongly. The first level that a key fails tells whether it is listed, exactly so for
every key of the corpus. Judging a URL then needs no look-up table, only the filters, whose size is known
from the counts before they are built.

A null URL, or one without `://`, has an empty host and path and fits no rule. Where no rule fits, the
verdict is the default. The longest rule wins (host and path together; on a tie the longer host). Of a rule
given under both verdicts the first verdict by name counts; incomplete rules are left out. Empty tables give empty results.
Other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwright.llm.common import Batches, mix64, store

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_FILTER_BITS = 1 << 31
LATER_RATE = 0.5


@dataclass
class Cascade:
    """Bit arrays by level; even levels hold listed keys, odd ones keys that are not listed."""

    levels: list[tuple[int, int, np.ndarray]] = field(default_factory=list)  # (bits, hashes, words)

    def listed(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), bool)
        inside = np.arange(len(keys))
        for number, level in enumerate(self.levels):
            passes = passing(level, number, keys[inside])
            out[inside[~passes]] = number % 2 == 1
            inside = inside[passes]
        out[inside] = len(self.levels) % 2 == 1
        return out


def bit_places(keys: np.ndarray, number: int, bits: int, hashes: int) -> np.ndarray:
    """The bits of every key at a level, one row per key."""
    a, b = mix64(keys, 2 * number + 1), mix64(keys, 2 * number + 2) | np.uint64(1)
    with np.errstate(over="ignore"):
        return ((a[:, None] + b[:, None] * np.arange(hashes, dtype=np.uint64)) % np.uint64(bits)).astype(np.int64)


def passing(level: tuple[int, int, np.ndarray], number: int, keys: np.ndarray) -> np.ndarray:
    bits, hashes, words = level
    at = bit_places(keys, number, bits, hashes)
    return ((words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool).all(axis=1)


def shape(count: int, rate: float) -> tuple[int, int]:
    """Bits and hash functions for a number of keys and a rate of false positives."""
    bits = max(64, math.ceil(-count * math.log(rate) / math.log(2) ** 2))
    if bits > MAX_FILTER_BITS:
        raise ValueError(f"a filter of {bits} bits would be sent to every task; the bound is {MAX_FILTER_BITS}")
    return bits, max(1, round(-math.log2(rate)))


def _filter(keys: DataFrame, number: int, count: int, rate: float) -> tuple[int, int, np.ndarray]:
    """One level from a column of keys: tasks set bits, words are or-ed before they are sent."""
    bits, hashes = shape(count, rate)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            at = np.unique(bit_places(batch.column(0).to_numpy().astype(np.uint64), number, bits, hashes))
            yield pa.RecordBatch.from_arrays(
                [pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))],
                names=["word", "bit"])

    words = np.zeros((bits + 63) // 64, np.uint64)
    set_words = keys.select("key").mapInArrow(run, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit"))
    for row in set_words.toLocalIterator():
        words[row["word"]] = np.uint64(row["bit"] & (2**64 - 1))
    return bits, hashes, words


def _through(keys: DataFrame, level: tuple[int, int, np.ndarray], number: int) -> DataFrame:
    def run(batches: Batches) -> Batches:
        for batch in batches:
            yield batch.filter(pa.array(passing(level, number, batch.column(0).to_numpy().astype(np.uint64))))

    return keys.select("key").mapInArrow(run, "key long")


def build(listed: DataFrame, universe: DataFrame) -> Cascade:
    """A cascade that is exact for every key of `universe` and of `listed` (one 64-bit column `key` each)."""
    cascade = Cascade()
    listed = store(listed.select("key").distinct(), "listed")
    wanted, other = listed.count(), None
    if not wanted:
        return cascade
    total = universe.count()
    inside, n = listed, wanted
    rate = min(LATER_RATE, max(1e-9, wanted / (math.sqrt(2) * max(1, total))))
    while n:
        number = len(cascade.levels)
        level = _filter(inside, number, n, rate if number == 0 else LATER_RATE)
        cascade.levels.append(level)
        # Those on the other side that pass this level become the keys of the next.
        if other is None:
            wrong = _through(universe, level, number).join(listed, "key", "left_anti")
        else:
            wrong = _through(other, level, number)
        other, inside = inside, store(wrong, "false-positives")
        n = inside.count()
    return cascade


def split_url(url):
    """(host, path) of a URL column."""
    text = F.coalesce(url, F.lit(""))
    pattern = "://([^/?#]*)([^?#]*)"
    return (F.translate(F.regexp_extract(text, pattern, 1), UPPER, LOWER), F.regexp_extract(text, pattern, 2))


def _candidates(host, path, shapes: list[tuple[int, int]]):
    """The keys of a URL: host suffixes of so many labels with path prefixes of so many characters."""
    keys = [F.when((F.size(F.split(host, "\\.")) >= labels) & (F.length(path) >= length),
                   F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, length)))
            for labels, length in shapes]
    return F.filter(F.array(*keys), lambda k: k.isNotNull()) if keys else F.array().cast("array<string>")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url",
          page_id: str = "page_id") -> DataFrame:
    """page_id, host, path, rule and verdict of every row. `rules`: verdict, host, path (starting with /)."""
    rules = rules.select("verdict", F.translate("host", UPPER, LOWER).alias("host"), "path").dropna()
    shapes = sorted((r[0], r[1]) for r in rules.select(
        F.size(F.split("host", "\\.")), F.length("path")).distinct().collect())
    verdicts = [r[0] for r in rules.select("verdict").distinct().orderBy("verdict").collect()]
    host, path = split_url(pages[url])
    parts = pages.select(pages[page_id].alias("page_id"), host.alias("host"), path.alias("path"))
    parts = parts.withColumn("keys", _candidates(F.col("host"), F.col("path"), shapes))
    universe = store(parts.select(F.explode("keys").alias("k")).distinct()
                     .select(F.xxhash64("k").alias("key")), "universe")
    rule_keys = rules.select("verdict", F.xxhash64(F.concat("host", "path")).alias("key"))
    cascades = {v: build(rule_keys.filter(F.col("verdict") == v), universe) for v in verdicts}
    kind = pages.schema[page_id].dataType.simpleString()

    def run(batches: Batches) -> Batches:
        for batch in batches:
            keys = batch.column(3).to_pylist()
            hashes = np.array([h for row in batch.column(4).to_pylist() for h in row], np.int64).astype(np.uint64)
            said = {v: c.listed(hashes) for v, c in cascades.items()}
            rule, verdict, at = [], [], 0
            for row in keys:
                best = None
                for i, key in enumerate(row):
                    found = next((v for v in said if said[v][at + i]), None)
                    rank = (len(key), key.index("/"))
                    if found and (best is None or rank > best[0]):
                        best = (rank, key, found)
                at += len(row)
                rule.append(best and best[1])
                verdict.append(best[2] if best else default)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                names=["page_id", "host", "path", "rule", "verdict"])

    hashed = parts.withColumn("hashes", F.transform("keys", lambda k: F.xxhash64(k)))
    return hashed.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")
