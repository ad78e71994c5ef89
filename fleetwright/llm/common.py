"""Small helpers shared by the operators: stored tables, Arrow columns, file systems."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetwright.session import new_path


#: Row groups of stored texts: a writer and a reader hold one of them in memory.
ROW_GROUP_BYTES = 32 << 20
ROWS_TOGETHER = 1024


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own under the folder that the driver and all executors share."""
    return new_path(spark, name)


def store(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared folder and read them again: a stage that outlives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """Reducers for an explicit repartition: the session's shuffle setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def offsets_of(lengths: np.ndarray) -> np.ndarray:
    """Where each run starts, with the total at the end."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of all runs, one after another."""
    ends = offsets_of(lengths)
    return np.arange(ends[-1]) + np.repeat(starts - ends[:-1], lengths)


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path inside it."""
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


def mix64(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) under a seed."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, as little-endian numbers; positions past the end read as zero."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))


def span_hashes(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every span: its length and its bytes, eight at a time, each mixed in by a finaliser."""
    view, sizes = eights(raw), last - first
    out = mix64(sizes, 3)
    open_, at = np.arange(len(first)), 0
    while len(open_):
        left = sizes[open_] - at
        bytes_ = view[first[open_] + at] & _FIRST[np.minimum(left, 8)]
        out[open_] = mix64(out[open_] ^ bytes_, 5)
        at += 8
        open_ = open_[left > 8]
    return out


def spans_equal(raw: np.ndarray, first: np.ndarray, sizes: np.ndarray, other: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Whether spans of `raw` equal those of the same sizes that begin in `other`."""
    view, held = eights(raw), eights(other)
    same = np.ones(len(first), bool)
    open_, at = np.arange(len(first)), 0
    while len(open_):
        left = sizes[open_] - at
        differ = (view[first[open_] + at] ^ held[begin[open_] + at]) & _FIRST[np.minimum(left, 8)]
        same[open_[differ != 0]] = False
        at += 8
        open_ = open_[(left > 8) & (differ == 0)]
    return same


def word_spans(raw: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every word."""
    inside = ~blank[raw]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    return edges[::2], edges[1::2]


def slices(text: bytes, blank: np.ndarray, size: int) -> list[bytes]:
    """A long text cut at blanks into parts of about `size` bytes; a word is never cut."""
    out, begin = [], 0
    while len(text) - begin > size:
        end = begin + size
        while end < len(text) and not blank[text[end]]:
            end += 1
        out.append(text[begin:end])
        begin = end
    return [*out, text[begin:]]


def set_aside(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows under plain column names, so that an operator's own columns cannot clash, and the name of each column."""
    names = {c: f"kept_{i}" for i, c in enumerate(df.columns)}
    return df.select(*(df[f"`{c}`"].alias(n) for c, n in names.items())), names


def one_string_column(df: DataFrame, column: str, name: str = "text"):
    """The column as a string whose nulls are empty texts."""
    return F.coalesce(df[column].cast("string"), F.lit("")).alias(name)


def give_back() -> None:
    """Return memory that a finished task no longer uses, so that a reused worker does not keep its peak."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


_kept: dict[tuple, object] = {}
_asked: set[tuple] = set()


def keep(make, *args):
    """What a worker makes once and keeps for as long as its tasks ask for it."""
    key = (make, *args)
    _asked.add(key)
    if key not in _kept:
        _kept[key] = make(*args)
    return _kept[key]


def drop_unasked() -> None:
    """Forget what the tasks of an earlier stage kept and this one did not ask for."""
    for key in _kept.keys() - _asked:
        del _kept[key]
    _asked.clear()


def lean(run):
    """A task's function over Arrow batches, given some rows at a time, that returns its memory when it ends."""
    @wraps(run)
    def wrapped(batches):
        try:
            yield from run(batch.slice(i, ROWS_TOGETHER) for batch in batches
                           for i in range(0, max(1, batch.num_rows), ROWS_TOGETHER))
        finally:
            drop_unasked()
            give_back()

    return wrapped


Batches = Iterator[pa.RecordBatch]
