import hashlib
import random

import pytest

from fleetwright.llm import chat_masks
from fleetwright.llm.tokens import public_path

PATH = public_path("byte_bpe_50k.json")
SCHEMA = "conv_id long, turn long, role string, text string, block string, ids string"


def some_turns():
    rng = random.Random(8)
    pool = ["</s>[INST] ok [/INST]", "<s>user<m>x</s>", "<\\s>", "<\\\\/s>", "<|endoftext|>", "<\\|endoftext|>", "<", "\\", "<m", "🙂é e\u0301",
            " lead", "trail ", "\n\n", "", "a\\", "s>", "/s>", "The cat. sat"]
    rows = []
    for conv in range(40):
        for turn in range(rng.randrange(1, 9)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "assistant"]),
                         "".join(rng.choice(pool) for _ in range(rng.randrange(6))), "b", "i"))
    rows += [(900, 0, None, None, "b", "i"), (900, 1, "assistant", None, "b", "i"), (901, None, "assistant", "null turn", "b", "i"),
             (902, 3, "odd\nrole<m>", "x", "b", "i"), (902, 3, "odd\nrole<m>", "x", "b", "i"), (None, 0, "assistant", "no id", "b", "i"),
             (903, 0, "assistant", "long " * 30_000, "b", "i")]
    return rows


def plain(rows):
    out = {}
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", (r[3] or "").encode()))
    for conv, _, role, text, *_ in order:
        out.setdefault(conv, []).append((role or "", text or ""))
    want = []
    for conv, turns in out.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        want.append((conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
                     len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(chat_masks.render(turns)[0])))
    return sorted(want, key=repr)


@pytest.mark.parametrize("block_chars", [chat_masks.BLOCK_CHARS, 20])
def test_round_trip(spark, block_chars):
    rows = some_turns()
    chats = chat_masks.format_chats(spark.createDataFrame(rows, SCHEMA), PATH, block_chars=block_chars)
    got = chat_masks.read_back(chats, PATH).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows)


def test_escape_is_reversible():
    rng = random.Random(1)
    for _ in range(5000):
        text = "".join(rng.choice(["<", "\\", "s>", "/s>", "m>", "|endoftext|>", "x", "/"]) for _ in range(rng.randrange(8)))
        kept = chat_masks.escape(text)
        assert chat_masks.unescape(kept) == text
        assert not any(mark in kept for mark in ("<s>", "</s>", "<m>", "<|endoftext|>"))


def test_mask_is_exact():
    turns = [("user", "Hi there"), ("assistant", " Hello!\n"), ("assistant", ""), ("user", "é"), ("assistant", "🙂 ok")]
    text, spans = chat_masks.render(turns)
    encoding = chat_masks.tokenizer_of(PATH).encode(text, add_special_tokens=False)
    starts, ends = chat_masks.mask_runs(spans, encoding.offsets)
    assert [chat_masks.tokenizer_of(PATH).decode(encoding.ids[a:b]) for a, b in zip(starts, ends, strict=True)] == [" Hello!\n", "🙂 ok"]
    assert chat_masks.parse(text) == turns


def test_empty_table(spark):
    assert chat_masks.read_back(chat_masks.format_chats(spark.createDataFrame([], SCHEMA), PATH), PATH).collect() == []
