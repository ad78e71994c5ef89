"""Chat formatting with offset-aligned loss masks.

The template writes a turn as `<s>` role `<m>` text `</s>`. Its control strings inside roles and texts are
escaped by a backslash after their first character (one more if some stand there already), so nothing else
changes and the escape can be undone. Conversations are rendered whole and encoded once, with offsets; the
control strings are tokens of their own, so no token reaches over the edge of a text. The sorted spans of
assistant texts are intersected with the sorted token spans by binary search; the tokens inside are the loss
mask, given as runs [start, end).

Rows are ordered by turn (then role, then text; nulls first); repeated rows are all kept. A null text or role
is empty; a null `conv_id` is a conversation of its own. A conversation longer than `BLOCK_CHARS` is given in
several rows, cut between turns and numbered by `block`, so that no task holds a conversation whole. Empty
tables give empty results. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from fleetwright.llm.common import Batches, one_string_column, partitions, store

OPEN, TEXT, CLOSE = "<s>", "<m>", "</s>"
LEARNED_ROLE = "assistant"
BLOCK_CHARS = 1 << 20

_CONTROL = re.compile(r"<(\\*)(/?s>|m>|\|endoftext\|>)")
_TURN = re.compile(r"<s>(.*?)<m>(.*?)</s>", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\1\\\2", text)


def unescape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"<{m[1][1:]}{m[2]}", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and the spans of its assistant texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = OPEN + escape(role) + TEXT, escape(text)
        if role == LEARNED_ROLE and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


@lru_cache(maxsize=2)
def tokenizer_of(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import AddedToken, Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.add_special_tokens([AddedToken(t, special=True, normalized=False) for t in (OPEN, TEXT, CLOSE)])
    return tokenizer


def mask_runs(spans: list[tuple[int, int]], offsets: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """First and last+1 token of every span. Both lists are sorted; a token may be a part of a character."""
    if not spans:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begins, ends = np.array([o[0] for o in offsets]), np.array([o[1] for o in offsets])
    return (np.searchsorted(begins, [s[0] for s in spans], "left"),
            np.searchsorted(ends, [s[1] for s in spans], "right"))


def format_chats(turns: DataFrame, tokenizer: str, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Stored rows (conv_id, block, n_turns, formatted, ids, loss_starts, loss_ends) in order of conv_id, block."""
    kind = turns.schema[conv_id].dataType.simpleString()
    names = ["conv_id", "block", "n_turns", "formatted", "ids", "loss_starts", "loss_ends"]

    def run(batches: Batches) -> Batches:
        number = TaskContext.get().partitionId() << 40
        encoder, key, held, chars, id_type, done = tokenizer_of(tokenizer), None, [], 0, pa.int64(), []

        def flush():
            nonlocal number
            formatted, spans = render(held)
            encoding = encoder.encode(formatted, add_special_tokens=False)
            starts, ends = mask_runs(spans, encoding.offsets)
            done.append((key, number, len(held), formatted, encoding.ids, starts.tolist(), ends.tolist()))
            number += 1

        def out():
            numbers = pa.list_(pa.int32())
            kinds = (id_type, pa.int64(), pa.int64(), pa.string(), numbers, numbers, numbers)
            rows = pa.RecordBatch.from_arrays(
                [pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], names=names)
            done.clear()
            return rows

        for batch in batches:
            id_type = batch.column(0).type
            for conv, said, body in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if held and (conv != key or chars > block_chars):
                    flush()
                    held, chars = [], 0
                key = conv
                held.append((said, body))
                chars += len(body) + len(said)
            yield out()
        if held:
            flush()
            yield out()

    rows = turns.select(turns[conv_id].alias("conv_id"), turns[turn].alias("turn"),
                        one_string_column(turns, role, "role"), one_string_column(turns, text))
    order = ("conv_id", "turn", "role", "text")
    # Ranges of turns: a conversation with very many turns is shared by several tasks.
    rows = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions(*order)
    return store(rows.mapInArrow(run, f"conv_id {kind}, block long, n_turns long, formatted string, ids array<int>, "
                                      "loss_starts array<int>, loss_ends array<int>"), "chats")


def read_back(chats: DataFrame, tokenizer: str) -> DataFrame:
    """Digests per conversation, from formatted texts, token ids and masks alone, read as a stream."""
    kind = chats.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Batches) -> Batches:
        decoder, key, state, id_type = tokenizer_of(tokenizer), None, None, pa.int64()

        def rows(done):
            kinds = (id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], names=names)

        def closed():
            n, turns, chars, loss, length = state
            return key, n, turns.hexdigest(), chars, loss.hexdigest(), length

        for batch in batches:
            id_type, done = batch.column(0).type, []
            for conv, formatted, ids, starts, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or conv != key:
                    if state is not None:
                        done.append(closed())
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(formatted):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for a, b in zip(starts, ends, strict=True):
                    text = unescape(decoder.decode(ids[a:b], skip_special_tokens=False))
                    state[2] += len(text)
                    state[3].update(text.encode("utf-8", "surrogatepass"))
                state[4] += len(formatted)
            yield rows(done)
        if state is not None:
            yield rows([closed()])

    # Texts are long beside their number: conversations are dealt by id and read in order of their blocks.
    dealt = chats.select("conv_id", "formatted", "ids", "loss_starts", "loss_ends", "block")
    dealt = dealt.repartition(partitions(chats.sparkSession), "conv_id").sortWithinPartitions("conv_id", "block").drop("block")
    return dealt.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, "
                                 "loss_sha256 string, formatted_chars long")
