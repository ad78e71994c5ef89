"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer (a prefix tree with weights) reads words as insults or threats, as words that address
someone, negate, or report what another said, or as clause ends. Three small machines follow a clause: one
is on after an address, one for `NEGATION_REACH` words after a negation, one from a reporting verb to the
clause's end. Their composition is one automaton over the word classes; when it reads an insult or threat it
emits a pattern (the kind of word under the states of the three machines) with the word's weight. A document
scores the logistic sum over its matched clauses' patterns.

Insult words and stems, with their weights, are learned from labelled rows: those that stand in toxic far
more often than in other documents, and after many different words (so that a copied passage teaches
nothing). Pattern weights are fitted on the same rows. The labelled rows used are at most `max_labels`, those
with the smallest hash of their id; whole texts are read, and every document is scored.

Null and empty texts match nothing and get the base score. Labels: null `toxic` or `doc_id` are left out; of
repeated ids the largest label counts. Without a label of each kind the score is the share of toxic rows.
Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetwright.llm.common import Batches, one_string_column, store

MAX_LABELS = 40_000
THRESHOLD = 0.3
STEMS = range(3, 9)
LEAST_ODDS, LEAST_COUNT, LEAST_CONTEXTS, LEXICON = 3.0, 5, 6, 4000
NEGATION_REACH = 3
CACHED_WORDS = 400_000

# Word classes of the lexical transducer.
OTHER, END, TARGET, NEGATION, REPORT, THREAT, INSULT = range(7)

TARGETS = "you your yours u du dich dir euch ihr tu toi te vous ton tes tú ti usted ustedes".split()
NEGATIONS = "not never no isn't aren't nicht kein keine nie pas jamais nunca ni".split()
REPORTS = ("said says claimed wrote quoted called reported sagte schrieb nannte dit disait écrit appelé dijo "
           "escribió llamó").split()
THREATS = ("kill hurt destroy murder stab burn töten umbringen verletzen tuer frapper détruire matar golpear "
           "destruir").split()
THREAT_WEIGHT = 2.0

_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;:,\n]")


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


# --- transducers -------------------------------------------------------------------------------------------

def _latch(on: int):
    """On from a word of this class to the end of the clause."""
    return 2, lambda state, word: 0 if word == END else 1 if word == on else state


def _fading(on: int, reach: int):
    """On for so many words after a word of this class, within the clause."""
    return reach + 1, lambda state, word: 0 if word == END else reach if word == on else max(0, state - 1)


def compose(*machines):
    """The product automaton: next state by state and word class, and which machines are on in each state."""
    states = list(itertools.product(*(range(n) for n, _ in machines)))
    number = {s: i for i, s in enumerate(states)}
    step = [[number[tuple(f(x, word) for x, (_, f) in zip(s, machines, strict=True))] for word in range(7)]
            for s in states]
    on = [sum((x > 0) << i for i, x in enumerate(s)) for s in states]
    return step, on


STEP, ON = compose(_latch(TARGET), _fading(NEGATION, NEGATION_REACH), _latch(REPORT))
PATTERNS = 2 * 8


class Lexicon(dict):
    """word -> (class, weight): fixed function words, learned words and learned stems."""

    def __init__(self, learned: dict[str, float]):
        super().__init__()
        self.learned = learned
        self.fixed = {w: (c, 0.0) for c, listed in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS))
                      for w in listed} | {w: (THREAT, THREAT_WEIGHT) for w in THREATS}

    def __missing__(self, word: str) -> tuple[int, float]:
        if len(self) > CACHED_WORDS:
            self.clear()
        if word in ".!?;:,\n":
            found = (END, 0.0)
        else:
            weights = [self.learned[k] for k in features(word) if k in self.learned]
            found = (INSULT, max(weights)) if weights else self.fixed.get(word, (OTHER, 0.0))
        self[word] = found
        return found

    def __reduce__(self):
        return Lexicon, (self.learned,)


def features(word: str) -> list[str]:
    """A word by itself (ended by $) and its stems."""
    return [word + "$", *(word[:n] for n in STEMS if n < len(word))]


def matched(text: str, lexicon: Lexicon) -> np.ndarray:
    """Weight emitted under each pattern: insult or threat, with or without address, negation, report."""
    out = np.zeros(PATTERNS)
    classes = list(map(lexicon.__getitem__, tokens(text)))
    if not any(c >= THREAT for c, _ in classes):
        return out
    begin = 0
    for i, (c, _) in enumerate([*classes, (END, 0.0)]):
        if c != END:
            continue
        clause = classes[begin:i]
        begin = i + 1
        if not any(c >= THREAT for c, _ in clause):
            continue
        # An address or reporting verb may also follow the insult, so its latch is set for the whole clause.
        kinds = {c for c, _ in clause}
        state = 0
        for c in (TARGET, REPORT):
            if c in kinds:
                state = STEP[state][c]
        for c, weight in clause:
            state = STEP[state][c]
            if c >= THREAT:
                out[(c == THREAT) * 8 + ON[state]] += weight
    return out


# --- learning ----------------------------------------------------------------------------------------------

def labelled_rows(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> DataFrame:
    """Stored rows (toxic, text) of the training labels; ids are few by construction, so texts don't move."""
    marks = (labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id")
             .agg(F.max("toxic").alias("toxic")))
    marks = marks.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)
    return store(docs.join(F.broadcast(chosen), "doc_id").select("toxic", "text"), "labelled")


def term_statistics(rows: DataFrame) -> DataFrame:
    """(feature, toxic, other, contexts): documents by label, and 64 bits of the words before it."""

    def run(batches: Batches) -> Batches:
        seen: dict[str, list[int]] = {}
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = tokens(text)
                for word in set(found):
                    for name in features(word):
                        seen.setdefault(name, [0, 0, 0])[0 if toxic else 1] += 1
                if toxic:
                    for before, word in zip(["", *found], found, strict=False):
                        bit = 1 << zlib.crc32(before.encode("utf-8", "surrogatepass")) % 63
                        for name in features(word):
                            seen[name][2] |= bit
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen.keys(), pa.string()), *(pa.array([v[i] for v in seen.values()], pa.int64()) for i in range(3))],
            names=["feature", "toxic", "other", "contexts"])

    found = rows.mapInArrow(run, "feature string, toxic long, other long, contexts long")
    return found.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"),
                                        F.bit_count(F.bit_or("contexts")).alias("contexts"))


def learn_lexicon(rows: DataFrame, n_toxic: int, n_other: int) -> dict[str, float]:
    """The features that tell toxic documents, with log-odds weights; at most `LEXICON`."""
    odds = (F.log((F.col("toxic") + 0.5) / F.lit(n_toxic + 1.0)) - F.log((F.col("other") + 0.5) / F.lit(n_other + 1.0)))
    best = (term_statistics(rows).filter((F.col("toxic") >= LEAST_COUNT) & (F.col("contexts") >= LEAST_CONTEXTS))
            .withColumn("odds", odds).filter(F.col("odds") >= LEAST_ODDS)
            .orderBy(F.desc(F.col("odds") * F.log1p("toxic")), "feature").limit(LEXICON))
    return {r["feature"]: r["odds"] for r in best.collect()}


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the first weight is the base."""
    x = np.column_stack([np.ones(len(x)), x])
    w, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    keep[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights

    def score(self, text: str) -> float:
        z = self.weights[0] + np.sqrt(matched(text, self.lexicon)) @ self.weights[1:]
        return float(1 / (1 + math.exp(-min(30.0, max(-30.0, z)))))


def learn(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> Model:
    rows = labelled_rows(docs, labels, max_labels)
    counts = {r["toxic"]: r["n"] for r in rows.groupBy((F.col("toxic") > 0).cast("int").alias("toxic"))
              .agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_other = counts.get(1, 0), counts.get(0, 0)
    if not n_toxic or not n_other:
        share = (n_toxic + 1) / (n_toxic + n_other + 2)
        return Model(Lexicon({}), np.array([math.log(share / (1 - share)), *[0.0] * PATTERNS]))
    lexicon = Lexicon(learn_lexicon(rows, n_toxic, n_other))

    def run(batches: Batches) -> Batches:
        for batch in batches:
            x = [matched(t, lexicon).tolist() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(x, pa.list_(pa.float64()))],
                                             names=["toxic", "x"])

    # At most max_labels rows of a few numbers each.
    seen = rows.mapInArrow(run, "toxic long, x array<double>").collect()
    return Model(lexicon, fit(np.sqrt(np.array([r["x"] for r in seen])), np.array([r["toxic"] > 0 for r in seen], float)))


def toxicity(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id",
             max_labels: int = MAX_LABELS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    rows = docs.select(docs[doc_id].alias("doc_id"), one_string_column(docs, text))
    model = learn(rows, labels.select("doc_id", "toxic"), max_labels)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Batches) -> Batches:
        for batch in batches:
            scores = [model.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = rows.mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"),
                         "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
