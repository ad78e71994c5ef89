import hashlib
import random
import re
import zlib

import pytest

from fleetwright.llm import turn_trie

SCHEMA = "conv_id long, turn long, role string, text string, place string, id string, node string"


def plain_rebuilt(rows):
    own = {}
    for conv, turn, role, text, *_ in sorted((r for r in rows if r[0] is not None),
                                             key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", (r[3] or "").encode())):
        own.setdefault(conv, []).append((role or "", text or ""))
    out = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 4
        out[conv] = own.get(conv - conv % 20, [])[:h] + turns[h:]
    return out


def plain_nodes(convs):
    members = {}
    for conv, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(conv)
    kids, leaves, saved = ({p: 0 for p in members} for _ in range(3))
    for prefix in sorted(members, key=len, reverse=True):
        leaves[prefix] = leaves[prefix] or 1
        if prefix:
            saved[prefix] += (len(members[prefix]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", prefix[-1][1]))
            kids[prefix[:-1]] += 1
            leaves[prefix[:-1]] += leaves[prefix]
            saved[prefix[:-1]] += saved[prefix]
    out = []
    for prefix, held in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in held if len(convs[c]) == len(prefix)))
        out.append((min(held), len(prefix), min(members[prefix[:-1]]) if prefix else None, len(held), kids[prefix],
                    leaves[prefix], saved[prefix], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def some_rows(seed=1, convs=150, hot=True):
    rng, rows = random.Random(seed), []
    texts = ["one two", "", None, " a\tb\x0bc d ", "é ü", "x", "long " * 50]
    for c in rng.sample(range(-40, 900), convs):
        for turn in range(rng.choice([1, 1, 2, 3, 4, 7])):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice(texts[:3] if turn < 2 else texts)))
    if hot:
        rows += [(c, t, "user", f"same {t}") for c in range(1000, 1300) for t in range(4)]
        rows += [(2001, t, "user", f"turn {t % 3}") for t in range(700)]
        rows += [(2002 + i, t, "user", f"turn {t % 3}") for i in range(3) for t in range(690 + i)]
    rows += [(3000, None, "user", "no turn"), (3000, 0, "user", "b"), (3000, 0, "user", "a"), (3000, 0, "user", "a"),
             (None, 0, "user", "no id"), (3013, 0, "user", "alone"), (3007, 5, None, None)]
    return [(*r, "p", "i", "n") for r in rows]


@pytest.mark.parametrize("sizes", [{}, {"range_keys": 1, "chunk_turns": 8, "bucket_ids": 16}, {"range_keys": 7}])
def test_trie_equals_plain(spark, sizes):
    rows = some_rows()
    turns = turn_trie.rebuilt(turn_trie.ordered_turns(spark.createDataFrame(rows, SCHEMA)))
    got = turn_trie.trie(turns, **sizes).collect()
    assert sorted(map(tuple, got), key=repr) == plain_nodes(plain_rebuilt(rows))


def test_radix_tree_layouts():
    """All four layouts, grown one by one, in any order of insertion."""
    rng = random.Random(3)
    for kids in (3, 4, 5, 16, 17, 48, 49, 256):
        keys = [b"stem" * 4 + bytes([b]) + bytes(15) for b in rng.sample(range(256), kids)] + [b"", b"stem" * 4]
        order = list(range(len(keys)))
        rng.shuffle(order)
        keys = [keys[i] for i in order]
        tree = turn_trie.RadixTree()
        for number, key in enumerate(keys):
            tree.insert(key, number)
        assert [n.kind for n in _inner(tree.root) if len(n.children()) > 1] == [next(k for k in (4, 16, 48, 256) if kids <= k)]
        nodes = turn_trie.aligned_nodes(tree)
        assert sorted((d, end) for _, d, _, end in nodes) == sorted((len(k) // 16, i) for i, k in enumerate(keys))


def _inner(node):
    return [node, *(x for child in node.children() for x in _inner(child))]


def test_random_trees():
    """Keys of two-byte turns: branches inside a turn's bytes give no nodes, paths without a branch give all of theirs."""
    rng = random.Random(9)
    for _ in range(200):
        keys = list({bytes(rng.choice(b"\0\1\xff") for _ in range(2 * rng.randrange(5))) for _ in range(rng.randrange(1, 20))})
        tree = turn_trie.RadixTree()
        for number, key in enumerate(keys):
            tree.insert(key, number)
        nodes = turn_trie.aligned_nodes(tree, 2)
        named = [(keys[some][:2 * d], None if parent < 0 else keys[nodes[parent][2]][:2 * nodes[parent][1]], end)
                 for parent, d, some, end in nodes]
        prefixes = {k[:i] for k in keys for i in range(0, len(k) + 1, 2)} | {b""}
        assert sorted(p for p, _, _ in named) == sorted(prefixes)
        assert all(above == (p[:-2] if p else None) and (end is None) == (p not in keys) for p, above, end in named)


def test_empty_table(spark):
    assert turn_trie.conversation_trie(spark.createDataFrame([], SCHEMA)).collect() == []
