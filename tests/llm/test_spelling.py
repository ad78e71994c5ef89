import random
import re
import zlib
from collections import Counter

import pytest

from fleetwright.llm import spelling_groups
from llm.helpers import awkward_rows, docs_of


def plain_vocabulary(rows):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def plain_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_groups(words):
    near = {w: [x for x in words if plain_edit(w, x)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return sorted(out)


def some_words():
    rng, words = random.Random(2), {}
    stems = ["".join(rng.choice("aeinrstàéÿßk") for _ in range(rng.randrange(6, 12))) for _ in range(30)]
    for stem in stems:
        for _ in range(12):
            w = list(stem)
            for _ in range(rng.randrange(3)):
                i = rng.randrange(len(w))
                w[i:i + rng.randrange(2)] = rng.choice(["", "e", "ü", "z"])
            words["".join(w)] = rng.choice([5, 6, 30, 31, 160, 900, 5000])
    words |= {"a" * n: 7 ** (n % 4) for n in (40, 47, 48, 49, 50, 51, 70)} | {"b" + "a" * 49: 5, "x" * 9: 5, "x" * 8 + "y": 25, "x" * 7 + "yy": 125}
    return words


@pytest.mark.parametrize("sizes", [(20_000, 200_000), (9, 200_000), (3, 4)])
def test_groups_equal_all_pairs(spark, sizes):
    words = some_words()
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    got = spelling_groups.spelling_groups(frame, shard_words=sizes[0], shard_searches=sizes[1]).collect()
    assert sorted(map(tuple, got)) == plain_groups(words)


def test_anagrams_meet_in_blocks(spark):
    """Words of one vector fill one leaf of the trie, which is searched in blocks."""
    rng = random.Random(4)
    words = {"".join(rng.sample("aeinrstol", 9)): 5 for _ in range(150)}
    words |= {w[:4] + "r" + w[5:]: 6 for w in list(words)[:40]}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    got = spelling_groups.near_pairs(frame, 10, 15).collect()
    want = {(a, b) for a in words for b in words if a < b and plain_edit(a, b)}
    assert sorted(tuple(sorted((r["a"], r["b"]))) for r in got) == sorted(want) and want
    assert all((words[r["a"]], words[r["b"]]) == (r["n_a"], r["n_b"]) for r in got)


def test_reached_nodes_hold_all_vectors_within_budget():
    rng = random.Random(6)
    for _ in range(300):
        own = "".join(rng.choice("01267") for _ in range(5))
        other = "".join(rng.choice("01267") for _ in range(5))
        over = sum(max(0, int(b) - int(a)) for a, b in zip(own, other, strict=True))
        under = sum(max(0, int(a) - int(b)) for a, b in zip(own, other, strict=True))
        found = spelling_groups.reached(own, "", 5)
        assert (other in found) == (over <= 1 and under <= 1 and other >= own) and len(found) == len(set(found))
        for node in spelling_groups.reached(own, "", 2):
            assert set(spelling_groups.reached(own, node, 5)) == {f for f in found if f[:2] == node}


def test_one_edit():
    rng = random.Random(7)
    for _ in range(20_000):
        a, b = ("".join(rng.choice("abé") for _ in range(rng.randrange(7))) for _ in range(2))
        assert spelling_groups.one_edit(a, b) == (a != b and plain_edit(a, b))


@pytest.mark.parametrize("kept", [spelling_groups.KEPT_RUNS, 3])
def test_vocabulary(spark, sf_dir, monkeypatch, kept):
    rows = [r for r in awkward_rows() for _ in range(3)]
    rows += [(r["doc_id"], r["text"], None, None) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    rows += [(i, f"{'é' * 90}x {'q' * 70}{i % 2} WÖRTERbuch Wörterbuch", None, None) for i in range(400)]
    counts, want = spelling_groups._Counts(199), plain_vocabulary(rows)
    for first in range(0, len(rows), 50):
        part = rows[first:first + 50]
        counts.add([r[0] for r in part], [re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "") for r in part])
    assert want.items() <= dict(zip(*(c.to_pylist() for c in counts.rows(6).columns), strict=True)).items() or kept == 3
    monkeypatch.setattr(spelling_groups, "KEPT_RUNS", kept)
    monkeypatch.setattr(spelling_groups, "CHARS_TOGETHER", 1000)
    got = spelling_groups.vocabulary(docs_of(spark, rows)).collect()
    assert {r["word"]: r["n"] for r in got} == want


def test_empty_table(spark):
    assert spelling_groups.variants(docs_of(spark, [])).collect() == []
    assert spelling_groups.variants(docs_of(spark, [(1, None, None, None), (None, "one", None, None)])).collect() == []
