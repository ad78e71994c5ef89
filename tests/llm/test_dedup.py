import hashlib
import random

import pytest

from fleetwright.llm import exact_dedup, jaccard_join
from llm.helpers import awkward_rows, docs_of, plain_components, plain_normal, plain_shingles


def plain_groups(rows):
    groups = {}
    for doc_id, text, _, _ in rows:
        groups.setdefault(plain_normal(text), []).append(doc_id)
    out = []
    for text, ids in groups.items():
        named = [i for i in ids if i is not None]
        keep = min(named) if named else None
        for i in ids:
            out.append((i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("id_bytes", [16, 1])
def test_exact_groups(spark, id_bytes):
    # With identifiers of one byte, chunks collide and recipes must be told apart by the verified contents.
    rng = random.Random(5)
    rows = awkward_rows() + [(100 + i, " ".join(rng.choice("abcdefgh") * 9 for _ in range(400)), None, None) for i in range(60)]
    rows += [(300 + i, rows[20 + i][1], None, None) for i in range(5)]
    got = exact_dedup.exact_groups(docs_of(spark, rows), id_bytes=id_bytes).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == plain_groups(rows)
    kept = {}
    for r in got:
        kept.setdefault(r["text_sha256"], []).append((r["kept"], r["doc_id"], r["keep_id"]))
    for held in kept.values():
        assert [d == k for good, d, k in held if good] == [True]


def test_chunks_depend_on_content_only():
    rng = random.Random(1)
    text = bytes(rng.randrange(97, 123) for _ in range(200_000))
    found = [c for _, c in exact_dedup.chunks(text)]
    assert b"".join(found) == text
    assert all(len(c) <= exact_dedup.MAX_CHUNK for c in found) and min(map(len, found[:-1])) >= exact_dedup.MIN_CHUNK
    moved = [c for _, c in exact_dedup.chunks(b"x" * 700 + text)]
    assert len(set(found) & set(moved)) > 0.9 * len(found)


def test_keep_first_keeps_rows_whole(spark):
    rows = awkward_rows()
    docs = docs_of(spark, rows)
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    texts = [plain_normal(r["text"]) for r in kept.collect()]
    assert sorted(texts) == sorted({plain_normal(t) for _, t, _, _ in rows})


def test_empty_tables(spark):
    docs = docs_of(spark, [])
    assert exact_dedup.exact_groups(docs).collect() == [] and exact_dedup.keep_first(docs).collect() == []
    assert jaccard_join.near_groups(docs).collect() == [] and jaccard_join.keep_one(docs).collect() == []


def near_rows():
    """Groups of near copies of several distances, a hot one, and a passage that many texts share."""
    rng = random.Random(11)
    rows, passage = [], [f"p{i}" for i in range(60)]
    for g in range(12):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.choice([3, 40, 120, 200]))]
        for copy in range(60 if g == 0 else 5):
            words = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 5])):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            rows.append((1000 * g + copy, " ".join(words), None, None))
    rows += [(50_000 + i, " ".join([*passage, *(f"o{i}q{k}" for k in range(i % 9))]), None, None) for i in range(40)]
    return rows


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80), (2, 50)])
def test_near_groups(spark, size, percent, monkeypatch):
    monkeypatch.setattr(jaccard_join, "GROUP_BLOCK", 16)
    monkeypatch.setattr(jaccard_join, "HUB_SHARE", 7)
    rows = awkward_rows() + near_rows()
    got = jaccard_join.near_groups(docs_of(spark, rows), size, percent).collect()
    want = plain_components([(i, t) for i, t, _, _ in rows], size, percent)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80), (2, 50)])
def test_all_links(spark, size, percent, monkeypatch):
    monkeypatch.setattr(jaccard_join, "LINK_BLOCK", 16)
    monkeypatch.setattr(jaccard_join, "LINK_ROWS", 50)
    rows = awkward_rows() + near_rows()
    sets = {plain_shingles(t, size) for _, t, _, _ in rows} - {frozenset()}
    want = {frozenset([a, b]): len(a & b) for a in sets for b in sets
            if a is not b and 100 * len(a & b) >= percent * len(a | b)}
    members, pairs = jaccard_join.similar_pairs(docs_of(spark, rows), size, percent)
    by_id = {}
    for i, t, _, _ in rows:
        by_id.setdefault(i, []).append(plain_shingles(t, size))
    of_class = {r["class_id"]: by_id[r["doc_id"]][0] for r in members.collect() if len(by_id[r["doc_id"]]) == 1}
    of_class |= {r["class_id"]: s for r in members.collect() for s in by_id[r["doc_id"]]
                 if r["class_id"] is not None and r["class_id"] not in of_class and len(s) == r["n_shingles"]}
    got = pairs.collect()
    assert len(got) == len(want) and all(r["a"] < r["b"] for r in got)
    assert {frozenset([of_class[r["a"]], of_class[r["b"]]]): r["both"] for r in got} == want
    counts = {s: sum(s in pair for pair in want) for s in sets}
    grouped = jaccard_join.near_groups(docs_of(spark, rows), size, percent, links=True).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["n_links"]) for r in grouped), key=repr) == sorted(
        ((i, len(plain_shingles(t, size)), counts.get(plain_shingles(t, size), 0)) for i, t, _, _ in rows), key=repr)


def test_matches_grow_with_cost():
    assert jaccard_join.choose_matches(__import__("numpy").zeros(50, int), 10, 8) == 1
    assert jaccard_join.choose_matches(__import__("numpy").full(50, 1000), 2, 8) > 4


def test_word_hashes_over_chunks(monkeypatch):
    text = (" ".join(f"w{i}" for i in range(5000)) + "  " + "z" * 500 + " end").encode()
    whole = jaccard_join.word_hashes(text)
    monkeypatch.setattr(jaccard_join, "CHUNK", 97)
    assert (jaccard_join.word_hashes(text) == whole).all() and len(whole) == 5002


def test_keep_one(spark):
    rows = [r for r in near_rows()]
    docs = docs_of(spark, rows)
    kept = jaccard_join.keep_one(docs, 3, 90)
    want = {c for _, _, c in plain_components([(i, t) for i, t, _, _ in rows], 3, 90)}
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(want)
    assert plain_shingles("a b", 3) == {("a", "b")}


def test_keep_one_tells_rows_of_an_id_apart(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    near = one.replace("a59", "x")
    rows = [(None, one, None, None), (None, near, None, None), (None, two, None, None), (5, three, None, None),
            (5, two + " end", None, None), (4, three + " end", None, None), (4, three + " end", None, None),
            (None, " ", None, None), (None, None, None, None), (6, "", None, None), (6, "", None, None)]
    kept = [(r["doc_id"], r["text"]) for r in jaccard_join.keep_one(docs_of(spark, rows), 5, 80).collect()]
    first = min([one, near], key=lambda t: hashlib.sha256(t.encode()).digest())
    want = [(None, first), (5, two + " end"), (4, three + " end"), (None, " "), (None, None), (6, ""), (6, "")]
    assert sorted(kept, key=repr) == sorted(want, key=repr)
