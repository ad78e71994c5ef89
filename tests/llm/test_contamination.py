import hashlib
import itertools
import random

import numpy as np
import pytest

from fleetwright.llm import decontaminate
from llm.helpers import awkward_rows, docs_of, plain_hits, plain_words


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def some_rows():
    rng = random.Random(2)
    words = [f"t{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 4, 10, 11, 25])))) for i in range(20)]
    items += [(7, "Über  Maß, x2"), (90, None), (91, " ... "), (92, "The QUICK brown"), (None, "no id")]
    docs = awkward_rows()
    for i in range(60):
        parts = [rng.choice(words) for _ in range(rng.randrange(30))]
        parts += (rng.choice(items)[1] or "").split()
        parts += [rng.choice(words) for _ in range(rng.randrange(30))]
        docs.append((200 + i, " ".join(parts), None, None))
    return docs, items


@pytest.mark.parametrize("segment_words", [decontaminate.SEGMENT_WORDS, 50])
def test_contamination(spark, segment_words):
    docs, items = some_rows()
    got = decontaminate.contamination(docs_of(spark, docs), items_of(spark, items), segment_words=segment_words).collect()
    plain = [("" if i is None else str(i), plain_words(t)) for i, t in items]
    want = []
    for doc_id, text, _, _ in docs:
        words = plain_words(text)
        hit, found = plain_hits(words, plain)
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        want.append((doc_id, len(words), len(hit), len(found), digest, bool(hit)))
    fields = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sorted((tuple(r[f] for f in fields) for r in got), key=repr) == sorted(want, key=repr)


def test_phrase_and_proximity_search(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(rng.choice("abcde") for _ in range(rng.randrange(40))), None, None) for i in range(30)]
    index = decontaminate.build_index(docs_of(spark, docs), segment_words=100)
    phrase = (b"a", b"b", b"c")
    got = sorted((r["doc_id"], r["position"]) for r in decontaminate.search(index, [("q", phrase)]).collect())
    words = {i: plain_words(t) for i, t, _, _ in docs}
    assert got == sorted((i, j) for i, w in words.items() for j in range(len(w)) if w[j:j + 3] == ["a", "b", "c"])
    near = sorted((r["doc_id"], r["position"], r["length"]) for r in decontaminate.search(index, [("q", phrase)], span=5).collect())
    want = set()
    for i, w in words.items():
        runs = [(a, b) for a, b in itertools.combinations(range(len(w) + 1), 2) if b - a <= 5 and {"a", "b", "c"} <= set(w[a:b])]
        want |= {(i, a, b - a) for a, b in runs if not any((c, d) != (a, b) and a <= c and d <= b for c, d in runs)}
    assert near == sorted(want)


def test_rarest_term_first():
    lists = {b"x": np.array([1, 5, 9]), b"y": np.array([2, 6])}
    assert decontaminate.phrase_starts((b"x", b"y"), lists, {b"x": 3, b"y": 2}).tolist() == [1, 5]
    assert decontaminate.phrase_starts((b"x", b"z"), lists, {b"x": 3}).tolist() == []


def test_empty_tables_and_filter(spark):
    docs, items = some_rows()
    assert decontaminate.contamination(docs_of(spark, []), items_of(spark, items)).collect() == []
    clean = decontaminate.contamination(docs_of(spark, docs), items_of(spark, [])).collect()
    assert len(clean) == len(docs) and not any(r["contaminated"] for r in clean)
    frame = docs_of(spark, docs)
    kept = decontaminate.drop_contaminated(frame, items_of(spark, items))
    plain = [(str(i), plain_words(t)) for i, t in items]
    bad = {i for i, t, _, _ in docs if plain_hits(plain_words(t), plain)[0]}
    assert kept.columns == frame.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted((i for i, *_ in docs if i not in bad), key=repr)


def test_large_test_sets_are_refused(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MAX_QUERY_WORDS", 1)
    with pytest.raises(ValueError):
        decontaminate.read_items(items_of(spark, [(1, "a b c d e f g h i j")]))


def test_rows_are_dropped_by_their_own_text(spark):
    leak = "one two three four five six seven eight nine ten eleven"
    rows = [(None, f"x {leak}", None, None), (None, "clean", None, None), (1, leak, None, None), (1, "clean too", None, None),
            (1, None, None, None), (None, "clean", None, None)]
    kept = decontaminate.drop_contaminated_rows(docs_of(spark, rows), items_of(spark, [(0, leak)])).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=repr) == sorted(
        ((i, t) for i, t, _, _ in rows if leak not in (t or "")), key=repr)
