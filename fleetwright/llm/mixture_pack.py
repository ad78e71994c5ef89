"""Packing by deficit round-robin over source queues.

Documents are queued by source, in order of `doc_id`. A window is a run of sequences. For each window every
queue is credited its share of the window's tokens (its target proportion); it sends whole tokens up to its
credit, the tokens still missing come from the queues with the largest credit, and what a queue was given
too much or too little stays on its account for the next window. When a queue runs dry the others share by
their proportions. The credits repeat after `PERIOD` windows, so a window's shares follow from its number:
every task places its documents by arithmetic, and accounts carry over windows and partitions alike. All
sequences are full but the last one.

Null texts are empty and hold the end id only. Rows without a source share the queue of the empty name.
Repeated rows are packed as often as they occur. Empty tables give empty results. Columns other than the
three named are not read. There are up to `MAX_QUEUES` queues. With more sources than that the largest (and
those with a target) have queues of their own, and the others are dealt to `SHARED_QUEUES` shared queues, one
source after another: every document is packed, and a shared queue has the proportion of its sources together.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetwright.llm.common import Batches, lean, one_string_column, store, texts_of
from fleetwright.llm.token_index import id_type
from fleetwright.llm.tokens import word_pieces

SEQUENCE = 4096
WINDOW_SEQUENCES = 16
PERIOD = 16
MAX_QUEUES = 256
SHARED_QUEUES = 64


def encoded(docs: DataFrame, tokenizer: str, end_id: int, text: str = "text", doc_id: str = "doc_id",
            source: str = "source") -> DataFrame:
    """Stored rows (part, queue, doc_id, n_tokens, first, ids) in order of queue and doc_id.

    first: tokens before the document in its queue, within its part. A queue is spread over parts, never
    brought to one task.
    """
    kind = id_type(tokenizer)

    def run(batches: Batches) -> Batches:
        part, queue, total, encoder = TaskContext.get().partitionId(), None, 0, word_pieces(tokenizer)
        for batch in batches:
            ids = [np.append(i, end_id).astype(kind) for i in encoder.encode(texts_of(batch.column(2)))]
            first = []
            for q, i in zip(batch.column(0).to_pylist(), ids, strict=True):
                if q != queue:
                    queue, total = q, 0
                first.append(total)
                total += len(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(ids), pa.int64()), batch.column(0), batch.column(1),
                 pa.array([len(i) for i in ids], pa.int64()), pa.array(first, pa.int64()),
                 pa.array([i.tobytes() for i in ids], pa.binary())],
                names=["part", "queue", "doc_id", "n_tokens", "first", "ids"])

    rows = docs.select(one_string_column(docs, source, "queue"), docs[doc_id].alias("doc_id"),
                       one_string_column(docs, text))
    key = docs.schema[doc_id].dataType.simpleString()
    rows = rows.repartitionByRange("queue", "doc_id").sortWithinPartitions("queue", "doc_id", "text")
    return store(rows.mapInArrow(
        lean(run), f"part long, queue string, doc_id {key}, n_tokens long, first long, ids binary"), "encoded")


def lines_of(totals: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """(queue, line, n): the queue that each source stands in. Names of lines begin with = or, if shared, with ~."""
    own = F.concat(F.lit("="), "queue")
    if len(totals.limit(MAX_QUEUES + 1).collect()) <= MAX_QUEUES:
        return totals.select("queue", own.alias("line"), "n")
    named = F.col("queue").isin(list(targets or ()))
    largest = (totals.filter(named) if targets else totals).orderBy(F.desc("n"), "queue")
    if targets and len(targets) > MAX_QUEUES - SHARED_QUEUES:
        raise ValueError(f"{len(targets)} targets; with more sources than {MAX_QUEUES} at most {MAX_QUEUES - SHARED_QUEUES}")
    alone = [r["queue"] for r in largest.limit(MAX_QUEUES - SHARED_QUEUES).collect()]
    shared = F.format_string("~%d", F.pmod(F.xxhash64("queue"), F.lit(SHARED_QUEUES)))
    return totals.select("queue", F.when(F.col("queue").isin(alone), own).otherwise(shared).alias("line"), "n")


def carried_over(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """(part, queue, line, carried): tokens of a line before a source's part; about one row for each part and source."""
    before = Window.partitionBy("line").orderBy("queue", "part").rowsBetween(Window.unboundedPreceding, -1)
    return (rows.groupBy("queue", "part").agg(F.sum("n_tokens").alias("n")).join(lines.select("queue", "line"), "queue")
            .select("queue", "part", "line", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("carried")))


def _apportion(total: int, weights: np.ndarray) -> np.ndarray:
    exact = weights / weights.sum() * total
    out = np.floor(exact).astype(np.int64)
    for i in np.argsort(out - exact, kind="stable")[:total - int(out.sum())]:
        out[i] += 1
    return out


def _period(shares: np.ndarray, window: int) -> np.ndarray:
    """Tokens of each queue in each window of a period in which queue q sends shares[q] in all."""
    credit, table = np.zeros(len(shares), np.int64), np.zeros((PERIOD, len(shares)), np.int64)
    for k in range(PERIOD - 1):
        credit += shares
        take = np.maximum(credit // PERIOD, 0)
        short = window - int(take.sum())
        owed = credit - take * PERIOD
        # Fewer than one token a queue is missing, or too much where an account is below zero.
        order = np.argsort(-owed, kind="stable")
        if short >= 0:
            take[order[:short]] += 1
        else:
            for q in order[::-1]:
                give = min(int(take[q]), -short)
                take[q] -= give
                short += give
        credit -= take * PERIOD
        table[k] = take
    table[-1] = shares - table[:-1].sum(axis=0)
    return table


class Schedule:
    """Where the tokens of each queue go."""

    def __init__(self, totals: dict[str, int], targets: dict[str, float] | None = None,
                 sequence: int = SEQUENCE, window_sequences: int = WINDOW_SEQUENCES):
        if len(totals) > MAX_QUEUES:
            raise ValueError(f"{len(totals)} queues; a mixture has at most {MAX_QUEUES}")
        self.names = sorted(totals)
        self.queue = {name: i for i, name in enumerate(self.names)}
        self.sequence, self.sequences, self.window = sequence, window_sequences, sequence * window_sequences
        left = np.array([totals[n] for n in self.names], np.int64)
        wanted = np.array([(targets or totals).get(n, 0) for n in self.names], float)
        self.parts: list[tuple[int, np.ndarray]] = []  # (first window, tokens by window and queue)
        window = 0
        while left.sum():
            weights = np.where(left > 0, wanted, 0.0)
            if not weights.sum():
                weights = np.where(left > 0, 1.0, 0.0)
            shares = _apportion(PERIOD * self.window, weights)
            table = _period(shares, self.window)
            whole = int((left[shares > 0] // shares[shares > 0]).min())
            if whole:
                self.parts.append((window, table))
                left, window = left - whole * shares, window + whole * PERIOD
            single = []
            for row in table:
                take = np.minimum(row, left)
                spare, short = left - take, self.window - int(take.sum())
                if short and spare.sum():
                    more = _apportion(min(short, int(spare.sum())), np.where(spare > 0, np.maximum(weights, 1e-12), 0))
                    take += np.minimum(more, spare)
                    for q in np.argsort(-(left - take), kind="stable"):
                        give = min(self.window - int(take.sum()), int(left[q] - take[q]))
                        take[q] += max(give, 0)
                if not take.sum():
                    break
                single.append(take)
                left = left - take
                if (take != row).any():
                    break
            if single:
                self.parts.append((window, np.array(single)))
                window += len(single)
        self.windows = window
        self._places()

    def _places(self) -> None:
        sent = np.zeros(len(self.names), np.int64)
        self.base, self.sent, self.inside = [], [], []
        for i, (first, table) in enumerate(self.parts):
            after = self.parts[i + 1][0] if i + 1 < len(self.parts) else self.windows
            self.base.append(sent.copy())
            self.sent.append(np.vstack([np.zeros_like(sent), np.cumsum(table, axis=0)]))
            self.inside.append(np.cumsum(table, axis=1) - table)
            sent = sent + table.sum(axis=0) * ((after - first) // len(table))
        self.base = np.array(self.base, np.int64).reshape(len(self.parts), len(self.names))

    def pieces(self, queue: str, first: int, n: int):
        """(offset in the document, length, sequence, offset there) of n tokens from a place in a queue."""
        q, done = self.queue[queue], 0
        while done < n:
            at = first + done
            p = int(np.searchsorted(self.base[:, q], at, "right")) - 1
            sent, inside = self.sent[p][:, q], self.inside[p]
            turns, rest = divmod(at - int(self.base[p, q]), int(sent[-1]))
            k = int(np.searchsorted(sent, rest, "right")) - 1
            window = self.parts[p][0] + turns * len(inside) + k
            place = int(inside[k, q]) + rest - int(sent[k])
            room = min(int(sent[k + 1]) - rest, self.sequence - place % self.sequence, n - done)
            yield done, room, window * self.sequences + place // self.sequence, place % self.sequence
            done += room


def pack(docs: DataFrame, tokenizer: str, end_id: int, targets: dict[str, float] | None = None,
         sequence: int = SEQUENCE, window_sequences: int = WINDOW_SEQUENCES, text: str = "text",
         doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """Pieces of all documents. `targets` maps sources to proportions; unset, the tokens' own proportions."""
    kind = id_type(tokenizer)
    rows = encoded(docs, tokenizer, end_id, text, doc_id, source)
    totals = store(rows.groupBy("queue").agg(F.sum("n_tokens").alias("n")), "totals")
    lines = store(lines_of(totals, targets), "lines")
    sums = {r["line"]: r["n"] for r in lines.groupBy("line").agg(F.sum("n").alias("n")).collect()}
    wanted = {f"={name}": share for name, share in targets.items()} if targets else None
    schedule = Schedule(sums, wanted, sequence, window_sequences)

    def run(batches: Batches) -> Batches:
        for batch in batches:
            out = [[] for _ in range(7)]
            keys = []
            for key, queue, line, n, raw, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for start, length, number, offset in schedule.pieces(line, first, n):
                    ids = np.frombuffer(raw, kind, length, start * np.dtype(kind).itemsize)
                    keys.append(key)
                    for column, value in zip(out, (start, length, zlib.crc32(ids.astype("<u4").tobytes()), n,
                                                   number, offset, queue), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, batch.column(0).type), *(pa.array(c, pa.int64()) for c in out[:6]),
                 pa.array(out[6], pa.string())],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"])

    # Stored first: its size is then known, and the ids need not move to meet it.
    carried = store(carried_over(rows, lines), "carried")
    placed = rows.join(carried, ["queue", "part"]).select(
        "doc_id", "queue", "line", "n_tokens", "ids", (F.col("first") + F.col("carried")).alias("first"))
    key = docs.schema[doc_id].dataType.simpleString()
    return placed.mapInArrow(lean(run), f"doc_id {key}, start long, length long, ids_crc32 long, doc_tokens long, "
                                        "sequence_id long, offset long, source string")
