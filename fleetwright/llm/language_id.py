"""Language identification by rank-order n-gram profiles.

A profile lists the most frequent character n-grams (1 to 3 letters of lower-cased words, words edged with a
blank) of a text or of a language's training texts, by rank. A text's distance to a language adds up, over
the text's profile, how far each n-gram stands from its rank in the language's profile; one that is missing
there counts the whole length of that profile. The nearest language wins; on a tie the first by name.

Training counts run over all training rows in Spark; only the profiles, of fixed length, reach the driver
(at most `MAX_LANGUAGES`). `lang_pred` is `und` with score 0 for a null text, a text without a letter, or
when there is nothing to learn from. The score is the relative gap between the best and the second distance,
or with one language 1 minus the relative distance. Rows without `doc_id` are scored, never learned from.
Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetwright.llm.common import ROWS_TOGETHER, Batches, drop_unasked, give_back, lean, set_aside

TEXT_TOP, LANGUAGE_TOP = 400, 400
MAX_LANGUAGES = 2000
COUNT_CHARS = 1 << 21
GRAM_CHARS = 1 << 17
ROWS_COUNTED = 10_000
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)])


def grams(text: str) -> np.ndarray:
    """All n-grams of a text: up to three code points of 21 bits in one number."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    c = np.concatenate([[32], np.where(letters()[points], points, 32), [32]])
    c = c[np.append(True, (c[1:] != 32) | (c[:-1] != 32))]  # one blank between words
    if len(c) < 2:
        return np.zeros(0, np.int64)
    pairs = c[:-1] | c[1:] << 21
    triples = (pairs[:-1] | c[2:] << 42)[c[1:-1] != 32]
    return np.concatenate([c[c != 32], pairs, triples])


def gram_text(gram: int) -> str:
    return "".join(chr(gram >> s & 0x1FFFFF) for s in (0, 21, 42) if gram >> s & 0x1FFFFF)


def pieces(text: str, size: int = COUNT_CHARS):
    """A very long text in slices that end at a blank where there is one."""
    begin = 0
    while len(text) - begin > size:
        end = text.rfind(" ", begin + size // 2, begin + size) + 1 or begin + size
        yield text[begin:end]
        begin = end
    yield text[begin:]


def whole_words(text: str, size: int = GRAM_CHARS):
    """A text in slices that end at blanks, longer ones only where there is none: together they have its n-grams."""
    begin = 0
    while len(text) - begin > size:
        end = text.rfind(" ", begin, begin + size) + 1 or text.find(" ", begin + size) + 1 or len(text)
        yield text[begin:end]
        begin = end
    yield text[begin:]


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams and their counts. Those of some slice are held at a time, eight bytes for each."""
    return added([np.unique(grams(w), return_counts=True) for p in pieces(text) for w in whole_words(p)])


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    names, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return names, np.bincount(place, np.concatenate([p[1] for p in parts])).astype(np.int64)


def profile(text: str, top: int = TEXT_TOP) -> np.ndarray:
    """The most frequent n-grams in order; equal counts by n-gram."""
    names, counts = counted(text)
    return names[np.lexsort((names, -counts))[:top]]


def held_out(doc_id, parts: int = 5, part: int = 0):
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def learn(rows: DataFrame, top: int = LANGUAGE_TOP) -> dict[str, np.ndarray]:
    """Profiles of the languages in rows (lang, text)."""

    def run(batches: Batches) -> Batches:
        found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        rows = 0

        def out() -> Batches:
            for lang, parts in found.items():
                names, counts = added(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(names), pa.string()), pa.array(names), pa.array(counts)],
                    names=["lang", "gram", "n"])
            found.clear()

        for batch in batches:
            texts: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                texts.setdefault(lang, []).append(text)
            for lang, held in texts.items():
                found.setdefault(lang, []).append(counted(" ".join(held)))
            rows += batch.num_rows
            if rows >= ROWS_COUNTED:
                yield from out()
                rows = 0
        yield from out()

    rows = rows.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    found = rows.mapInArrow(lean(run), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)
    out: dict[str, list] = {}
    for row in best.select("lang", "place", "gram").toLocalIterator():
        out.setdefault(row["lang"], []).append((row["place"], row["gram"]))
        if len(out) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    return {lang: np.array([g for _, g in sorted(held)], np.int64) for lang, held in sorted(out.items())}


class Profiles:
    """The languages' ranks of every n-gram that any of them lists."""

    def __init__(self, learned: dict[str, np.ndarray]):
        self.names = list(learned)
        self.grams = np.unique(np.concatenate([*learned.values(), np.zeros(0, np.int64)]))
        self.absent = max([len(p) for p in learned.values()], default=0)
        self.ranks = np.full((len(self.grams) + 1, len(self.names)), self.absent, np.int64)
        for i, listed in enumerate(learned.values()):
            self.ranks[np.searchsorted(self.grams, listed), i] = np.arange(len(listed))

    def nearest(self, text: str | None) -> tuple[str, float]:
        listed = profile(text or "")
        if not len(listed) or not self.names:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.grams, listed), len(self.grams) - 1)
        known = self.grams[at] == listed
        apart = np.abs(self.ranks[np.where(known, at, len(self.grams))] - np.arange(len(listed))[:, None])
        apart[self.ranks[np.where(known, at, len(self.grams))] == self.absent] = self.absent
        total = apart.sum(axis=0)
        best = int(np.argmin(total))
        if len(total) == 1:
            return self.names[0], 1 - float(total[0]) / (len(listed) * self.absent)
        second = float(np.partition(total, 1)[1])
        return self.names[best], (second - float(total[best])) / second if second else 0.0


def predicted(text: Column, learned: dict[str, np.ndarray]) -> Column:
    """(lang_pred, score) of a text; only the texts go to Python and only the answers come back."""
    profiles = Profiles(learned)
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])

    @F.arrow_udf("lang_pred string, score double")
    def said(texts: pa.Array) -> pa.Array:
        answers = [profiles.nearest(t) for i in range(0, len(texts), ROWS_TOGETHER)
                   for t in texts.slice(i, ROWS_TOGETHER).to_pylist()]
        drop_unasked()
        give_back()
        return pa.array([{"lang_pred": name, "score": score} for name, score in answers], kind)

    return said(text.cast("string"))


def identify(docs: DataFrame, learned: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """docs with lang_pred and score added (columns of these names are replaced)."""
    rest = [docs[f"`{c}`"] for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.select(*rest, predicted(docs[text], learned).alias("said")).select(*rest, "said.*")


def languages(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """Learn from the rows that are not held out; doc_id, held_out, lang_pred and score of all rows."""
    rows = docs.select(docs[doc_id].alias("doc_id"), held_out(docs[doc_id]).alias("held_out"),
                       docs[lang].alias("lang"), docs[text].cast("string").alias("text"))
    learned = learn(rows.filter("NOT held_out AND doc_id IS NOT NULL"))
    return identify(rows.drop("lang"), learned).select("doc_id", "held_out", "lang_pred", "score")


def keep_known(docs: DataFrame, least_score: float = 0.0, text: str = "text", lang: str = "lang",
               doc_id: str = "doc_id") -> DataFrame:
    """The rows whose language is recognised with at least this score, with all their columns.

    Where no row has a language to learn from, all rows stay.
    """
    rows = docs.filter(~held_out(docs[doc_id]) & docs[doc_id].isNotNull())
    learned = learn(rows.select(docs[lang].alias("lang"), docs[text].alias("text")))
    if not learned:
        return docs
    held, names = set_aside(docs)
    said = held.withColumn("said", predicted(held[names[text]], learned))
    said = said.filter((F.col("said.lang_pred") != UNKNOWN) & (F.col("said.score") >= least_score))
    return said.select(*(F.col(n).alias(c) for c, n in names.items()))
