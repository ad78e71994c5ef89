"""Keyed streams judged in the order of event time (V3, and R5 and R6 as streams).

Rows wait in state until the watermark has passed them and are then judged in the order of their key, so a row that
comes late, but within the allowance, counts as if it had come in time; one that comes later is dropped. State holds
a key's waiting rows and what its judge remembers, and nothing of a key for which both are empty.

A call into Python costs far more than judging a row, so keys are dealt to shares, and a share is one call and one
state value: ids that follow each other have shares of their own until all shares are taken, and a large fleet makes
as many calls a micro-batch as there are shares, however many its keys. A micro-batch reads and writes the shares it touches or whose
rows have come due, of no others. Rows go to Python as one text each, since every column costs a conversion a call.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Shares that keys are dealt to; a checkpoint is tied to this number. A prime, so that ids at even distances spread.
SHARES = 65_537

#: A row as its judge sees it, by column name, and what the judge remembers of the key.
Judge = Callable[[dict, dict], dict | None]


def _share(keys: list[str], types: dict[str, str], shares: int) -> Column:
    """The share of a key: whole numbers count as they are, others by their hash."""
    share = F.lit(0).cast("long")
    for key in keys:
        number = F.col(key) if types[key] in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(key)
        share = F.pmod(share * 31 + F.coalesce(F.pmod(number.cast("long"), F.lit(shares)), F.lit(0)), F.lit(shares))
    return share


def in_event_order(stream: DataFrame, keys: list[str], order: list[str], columns: list[str], judge: Judge,
                   out: list[str], added: dict[str, str] | None = None, late: str = "1 hour",
                   forget_ms: int | None = None, shares: int = SHARES) -> DataFrame:
    """The rows that `judge(memory, row)` lets pass, with its values for the `added` columns.

    `stream` has `ts` as a timestamp; of equal times `order` decides. The judge sees `columns`, changes the
    key's memory (of plain values) in place and returns None for a row that gives no output. With `forget_ms`
    what a key remembers goes when no row of it has come for so long in event time.
    """
    added = added or {}
    types = {f.name: f.dataType.simpleString() for f in stream.schema}
    read = [*keys, *order, *(c for c in columns if c not in order)]
    numbers = [1 + i for i, c in enumerate(read) if types[c] in ("float", "double")]
    # Micros, so that time zones of workers do not matter.
    fields = [F.unix_micros("ts").alias("0"), *(
        (F.when(~F.isnan(c), F.col(c)) if 1 + i in numbers else F.col(c)).alias(str(1 + i)) for i, c in enumerate(read))]
    timed = stream.withWatermark("ts", late).select(
        _share(keys, types, shares).alias("share"), "ts",
        F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("packed"))
    given = [*(c for c in out if c != "ts"), *added]
    kinds = {**types, **added}
    schema = ", ".join(["us long", *[f"`{c}` {kinds[c]}" for c in given]])
    after_keys, ranked = 1 + len(keys), 1 + len(keys) + len(order)

    def step(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # A waiting row is its micros and values; of a key: what the judge remembers, its newest row, when to forget.
        waiting, held = json.loads(state.get[0]) if state.exists else ([], [])
        mark = state.getCurrentWatermarkMs()
        for frame in frames:
            for row in json.loads("[" + ",".join(frame["packed"]) + "]"):
                values = list(row.values())
                for i in numbers:
                    # Infinite ones come as texts.
                    values[i] = None if values[i] is None else float(values[i])
                waiting.append(values)
        busy = {tuple(r[1:after_keys]) for r in waiting}
        kept = {tuple(key): what for key, *what in held
                if forget_ms is None or what[2] >= mark or tuple(key) in busy}
        due = sorted((r for r in waiting if r[0] < mark * 1000),
                     key=lambda r: (r[0], [(v is not None, v) for v in r[after_keys:ranked]]))
        rest = [r for r in waiting if r[0] >= mark * 1000]
        found = []
        for r in due:
            row = dict(zip(read, r[1:], strict=True))
            what = kept.setdefault(tuple(r[1:after_keys]), [{}, 0, 0])
            what[1] = max(what[1], r[0])
            more = judge(what[0], row)
            if more is not None:
                found.append([r[0], *({**row, **more}[c] for c in given)])
        kept = {key: what for key, what in kept.items() if what[0]}
        calls = [max(mark, min(r[0] for r in rest) // 1000) + 1] if rest else []
        if forget_ms is not None:
            later = {tuple(r[1:after_keys]) for r in rest}
            for key, what in kept.items():
                if key in busy:
                    what[2] = max(mark + 1, what[1] // 1000 + forget_ms)
                if key not in later:
                    calls.append(max(mark + 1, what[2]))
        if rest or kept:
            state.update((json.dumps([rest, [[key, *what] for key, what in kept.items()]]),))
            if calls:
                state.setTimeoutTimestamp(min(calls))
        elif state.exists:
            state.remove()
        if found:
            yield pd.DataFrame(found, columns=["us", *given], dtype=object)

    passed = timed.groupBy("share").applyInPandasWithState(
        step, schema, "state string", "append", GroupStateTimeout.EventTimeTimeout)
    return passed.withColumn("ts", F.timestamp_micros("us")).select(*out, *added)


def turns_on(memory: dict, row: dict) -> dict | None:
    """R4's judge: passes a row whose condition holds and did not hold at the row before."""
    if not row["is_on"]:
        memory.clear()
        return None
    if memory.get("on"):
        return None
    memory["on"] = True
    return {}


def turns_on_unmuted(memory: dict, row: dict) -> dict | None:
    """R6's judge, over samples and switches of a cluster: muting forgets what was shown."""
    if row["kind"] == 0:
        if row["muted"]:
            memory["span"] = memory.get("span", 0) + 1
            memory["muted"] = True
            memory.pop("on", None)
        elif row["muted"] is not None:
            memory.pop("muted", None)
        return None
    if memory.get("muted"):
        return None
    shown = memory.setdefault("on", [])
    was_on = row["metric"] in shown
    if row["is_on"] and not was_on:
        shown.append(row["metric"])
    elif was_on and not row["is_on"]:
        shown.remove(row["metric"])
    if not shown:
        memory.pop("on")
    return {"span": memory.get("span", 0)} if row["is_on"] and not was_on else None


def changes_unmuted(memory: dict, row: dict) -> dict | None:
    """R5's judge, over alert keys and switches of a cluster: muting keeps the key that was shown last."""
    if row["kind"] == 0:
        if row["muted"]:
            memory["muted"] = True
        elif row["muted"] is not None:
            memory.pop("muted", None)
        return None
    if memory.get("muted"):
        return None
    before = memory.get("shown", "")
    if row["shown"]:
        memory["shown"] = row["shown"]
    else:
        memory.pop("shown", None)
    return {} if row["shown"] and row["shown"] != before else None
