"""Awkward documents and plain versions of the operators."""

from __future__ import annotations

import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long, recipe string, block long, class_id string, " \
       "score string, queue int, kept_id string, lang_pred string, segment string, held_out string"
CLASH = ("r", 1, "c", "s", 2, "k", "l", "g", "h")


def docs_of(spark, rows):
    """rows: (doc_id, text, lang, source); the other columns bear names that operators use inside."""
    return spark.createDataFrame([(i, t, lang, source, len(t or ""), *CLASH) for i, t, lang, source in rows], DOCS)


def twin_words(letters=1024):
    """Two words that every polynomial hash modulo 2^64 takes for equal: a Thue-Morse word and its complement."""
    bits = [bin(i).count("1") & 1 for i in range(letters)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def awkward_rows():
    long_text = " ".join(f"word{i % 977} und{i % 13}" for i in range(40_000))
    base = " ".join(f"alpha{i} beta{i % 7}" for i in range(150))
    return [
        (1, "The quick  brown\tfox\njumps.", "en", "a"), (2, "The quick brown fox jumps.", "en", "a"),
        (3, None, "en", "a"), (4, "", None, None), (5, " ", "de", "b"), (6, "\n\t ", "de", "b"),
        (7, "Ünïcode ß ÄÖ 🙂 e\u0301 naïve", "de", None), (8, long_text, "en", "a"), (9, long_text, "en", "c"),
        (10, base, "fr", "b"), (11, base + " gamma", "fr", "b"), (12, base.replace("alpha7 ", "omega "), "fr", "b"),
        (12, base.replace("alpha7 ", "omega "), "fr", "b"), (13, "one two", None, "c"), (13, "three", None, "c"),
        (None, "The quick brown fox jumps.", "en", "a"), (None, "no id", "en", None), (None, None, None, None),
        (16, f"x {twin_words()[0]} y z", "en", "a"), (17, f"x {twin_words()[1]} y z", "en", "a"),
        (14, "12345 !!! ---", "en", "a"), (15, "<|endoftext|> The <|ENDOFTEXT|>,, it's we'll .,;x", "en", "a"),
    ]


def plain_normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def plain_words(text):
    folded = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def plain_shingles(text, size):
    folded = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", folded) if w]
    if len(words) < size:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i:i + size]) for i in range(len(words) - size + 1))


def plain_components(rows, size, percent):
    """[(doc_id, n_shingles, component_id)] by comparing all pairs; ids may repeat or be null."""
    sets = [plain_shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        held = [x for x in (least.get(find(i)), doc_id) if x is not None]
        least[find(i)] = min(held) if held else None
    return [(d, len(s), least[find(i)] if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def plain_hits(words, items, size=10):
    """(hit positions, items) of a document by comparing every window."""
    hit, found = set(), set()
    for item, phrase in items:
        k = min(size, len(phrase))
        for i in range(len(phrase) - k + 1 if phrase else 0):
            for j in range(len(words) - k + 1):
                if words[j:j + k] == phrase[i:i + k]:
                    hit |= set(range(j, j + k))
                    found.add(item)
    return hit, found
