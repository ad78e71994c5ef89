import tracemalloc
import unicodedata
import zlib
from collections import Counter

import numpy as np

from fleetwright.llm import language_id, toxicity
from fleetwright.llm.queries import QUERIES
from llm.helpers import awkward_rows, docs_of


def test_grams():
    assert sorted(map(language_id.gram_text, language_id.grams("Ab 1c"))) == sorted(
        ["a", "b", "c", " a", "ab", "b ", " c", "c ", " ab", "ab ", " c "])
    assert len(language_id.grams("12 .!")) == 0 == len(language_id.grams(""))
    whole = language_id.counted("some words in a row " * 500)
    language_id.COUNT_CHARS, kept = 100, language_id.COUNT_CHARS
    cut = language_id.counted("some words in a row " * 500)
    language_id.COUNT_CHARS = kept
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()


def test_counting_holds_the_grams_of_a_slice_at_a_time():
    text = " ".join(f"word{'abcdefghij'[i % 10]}ß{'klmnopqrst'[i // 10 % 10]} x" for i in range(150_000)) + "z" * 300_000
    assert len(text) < language_id.COUNT_CHARS
    assert "".join(language_id.whole_words(text)) == text
    names, counts = np.unique(language_id.grams(text), return_counts=True)
    tracemalloc.start()
    got = language_id.counted(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got[0] == names).all() and (got[1] == counts).all()
    assert peak < 40 << 20


def test_out_of_place_distance():
    a, b = (np.array([ord(c) for c in s], np.int64) for s in ("abc", "cba"))
    profiles = language_id.Profiles({"x": a, "y": b})
    assert profiles.nearest("aaa bb")[0] == "x" and profiles.nearest("ccc bb")[0] == "y"
    assert profiles.nearest(None) == profiles.nearest("123") == ("und", 0.0)
    assert language_id.Profiles({}).nearest("abc") == ("und", 0.0)
    # A plain version of the distance.
    listed = language_id.profile("ccc bb a")
    plain = {n: sum(abs(p.tolist().index(g) - r) if g in p else 3 for r, g in enumerate(listed.tolist())) for n, p in (("x", a), ("y", b))}
    best, second = sorted(plain.values())
    assert profiles.nearest("ccc bb a") == (min(plain, key=plain.get), (second - best) / second)


def plain_grams(text):
    words = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in (text or "").lower()).split()
    line = f" {' '.join(words)} " if words else ""
    return Counter(g for n in (1, 2, 3) for i in range(len(line) - n + 1)
                   if (g := line[i:i + n]).strip() and (n < 3 or g[1] != " "))


def plain_profile(counts, top=400):
    order = sorted(counts, key=lambda g: (-counts[g], [ord(c) for c in reversed(g.ljust(3, "\0"))]))
    return {g: rank for rank, g in enumerate(order[:top])}


def test_query_equals_a_plain_version(spark, sf_dir):
    """Profiles counted, cut and compared gram by gram over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    counts = {}
    for r in docs:
        if zlib.crc32(str(r["doc_id"]).encode()) % 5 and r["lang"] is not None:
            counts.setdefault(r["lang"], Counter()).update(plain_grams(r["text"]))
    learned = {lang: plain_profile(c) for lang, c in sorted(counts.items())}
    most, want = max(map(len, learned.values())), []
    for r in docs:
        own = plain_profile(plain_grams(r["text"]))
        apart = {lang: sum(abs(listed[g] - rank) if g in listed else most for g, rank in own.items()) for lang, listed in learned.items()}
        best, second = sorted(apart.values())[:2]
        said = (min(apart, key=apart.get), (second - best) / second) if own else ("und", 0.0)
        want.append((r["doc_id"], zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0, *said))
    got = QUERIES["op1_language_id"](spark, sf_dir).select("doc_id", "held_out", "lang_pred", "score").collect()
    assert len(learned) > 2 and sorted(map(tuple, got)) == sorted(want)


def test_languages_awkward(spark):
    rows = awkward_rows()
    got = language_id.languages(docs_of(spark, rows)).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (3, 4, 5, 6, 14)} == {"und"}
    assert {r["lang_pred"] for r in got} <= {"en", "de", "fr", "und"}
    assert language_id.languages(docs_of(spark, [])).collect() == []
    unlabelled = docs_of(spark, [(1, "text", None, None)])
    assert [(r["lang_pred"], r["score"]) for r in language_id.languages(unlabelled).collect()] == [("und", 0.0)]
    kept = language_id.keep_known(docs_of(spark, rows), 0.0)
    assert kept.columns == docs_of(spark, rows).columns and kept.filter("text IS NULL OR text = ''").count() == 0


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    said = {r["doc_id"]: r for r in language_id.languages(docs).collect()}
    held = [(r["lang"], said[r["doc_id"]]["lang_pred"]) for r in docs.collect() if said[r["doc_id"]]["held_out"]]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    # Predictions depend on the text alone.
    again = language_id.languages(docs.withColumn("source", docs["lang"]))
    assert {r["doc_id"]: r["score"] for r in again.collect()} == {i: r["score"] for i, r in said.items()}


def test_automaton():
    lexicon = toxicity.Lexicon({"idio": 2.0})
    seen = lambda text: {i: w for i, w in enumerate(toxicity.matched(text, lexicon)) if w}
    assert seen("an idiot") == {0: 2.0} and seen("You idiot") == {1: 2.0} and seen("idiot, you") == {0: 2.0}
    assert seen("not an idiot") == {2: 2.0} and seen("not at all such a big idiot") == {0: 2.0}
    assert seen("he said you are no idiot") == {7: 2.0} and seen("I kill you") == {9: toxicity.THREAT_WEIGHT}
    assert seen("idiot. not. idiot") == {0: 4.0} and seen("") == seen("plain words") == {}
    step, on = toxicity.compose(toxicity._latch(toxicity.TARGET), toxicity._fading(toxicity.NEGATION, 2))
    assert len(step) == len(on) == 6 and all(len(row) == 7 for row in step)


def test_toxicity_awkward(spark):
    labels = "doc_id long, quality int, toxic int, score string"
    rows = awkward_rows()
    marks = spark.createDataFrame([(i, 1, i % 2, "s") for i in range(16)] + [(1, None, None, "s"), (None, 1, 1, "s")], labels)
    got = toxicity.toxicity(docs_of(spark, rows), marks).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    assert toxicity.toxicity(docs_of(spark, []), marks).collect() == []
    assert len(toxicity.toxicity(docs_of(spark, rows), spark.createDataFrame([], labels)).collect()) == len(rows)


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    said = toxicity.toxicity(docs, labels).filter("held_out").join(labels, "doc_id").filter("toxic IS NOT NULL").collect()
    caught = sum(r["predicted"] for r in said if r["toxic"])
    wrong = sum(r["predicted"] for r in said if not r["toxic"])
    assert caught >= 0.9 * sum(r["toxic"] for r in said) and wrong <= 0.02 * len(said)


def test_fit_separates():
    x = np.array([[0.0], [0.1], [2.0], [3.0]])
    w = toxicity.fit(x, np.array([0, 0, 1, 1.0]))
    assert w[0] < 0 < w[1]
