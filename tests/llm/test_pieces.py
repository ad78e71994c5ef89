import hashlib
import random

import pytest

from fleetwright.llm import piece_codec
from fleetwright.llm.queries import QUERIES
from fleetwright.llm.tokens import public_path
from llm.helpers import awkward_rows, docs_of

MODEL = public_path("piece_bpe_32k.model")
PARTS = [" ", "  ", "\n", "\t", "a", "e", "th", "the", "ing", " t", "1", "23", "ü", "́", "🙂", "中", "文", "▁", "<s>", "<0x41>", "\0",
         "</s>", "'", "...", "=====", "    ", "aaaa", "ab", "он", "ст", "​", "ﬁ", "　", "�"]


@pytest.fixture(scope="module")
def library():
    return piece_codec.decoder_of(MODEL)


def test_ids_equal_the_library(library):
    rng, units = random.Random(3), piece_codec.units_of(MODEL)
    for _ in range(20_000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(12)))
        assert units.encode(text) == library.encode(text), text
    for _ in range(20_000):
        word = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzäöüßéABC") for _ in range(rng.randrange(1, 30)))
        assert units.encode(word) == library.encode(word), word


@pytest.mark.parametrize("text", ["a" * 30_000, " " * 30_000, "ab" * 20_000, "=-" * 20_000, "中" * 20_000, "🙂" * 9_000, "xq" * 9_000])
def test_long_units(library, text):
    assert piece_codec.units_of(MODEL).encode(text) == library.encode(text)


def test_backtracking_is_needed(library):
    """Texts whose longest first match is wrong, so that tokens are shortened and positions marked."""
    model, greedy = piece_codec.PieceModel(MODEL), 0
    rng = random.Random(5)
    for _ in range(3000):
        unit = "▁" + "".join(rng.choice("aeinrstlodu") for _ in range(rng.randrange(2, 14)))
        got, at, first = model.tokens(unit), 0, []
        while at < len(unit):
            first.append(model._match(unit, at, {}))
            at += len(first[-1])
        assert got == model.merge(unit)
        greedy += got == first
    assert greedy < 2700


def test_small_tables_give_the_same(library, monkeypatch):
    for name in ("KEPT_UNITS", "KEPT_PAIRS", "LONGEST_KEPT"):
        monkeypatch.setattr(piece_codec, name, 5)
    monkeypatch.setattr(piece_codec, "WINDOW", 20)
    units = piece_codec.Units(piece_codec.PieceModel(MODEL))
    for text in ["the quick brown fox " * 30, "ababab" * 40, "  x   y\n\n"]:
        assert units.encode(text) == library.encode(text)


def test_awkward_rows(spark, library, monkeypatch):
    monkeypatch.setattr(piece_codec, "CHARS_TOGETHER", 1000)
    rows = awkward_rows()
    encoded = piece_codec.encode(docs_of(spark, rows).withColumnRenamed("class_id", "ids"), MODEL)
    got = sorted(map(tuple, encoded.collect()), key=repr)
    assert got == sorted(((r[0], library.encode(r[1] or "")) for r in rows), key=repr)
    back = sorted(map(tuple, piece_codec.decode(encoded, MODEL).collect()), key=repr)
    assert back == sorted(((r[0], library.decode(library.encode(r[1])) if r[1] else "") for r in rows), key=repr)


def test_empty_table_and_null_ids(spark):
    empty = piece_codec.encode(docs_of(spark, []), MODEL)
    assert empty.collect() == [] and piece_codec.digests(empty, MODEL).collect() == []
    none = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert [tuple(r) for r in piece_codec.decode(none, MODEL).collect()] == [(1, "")]


def test_query(spark, sf_dir, library):
    want = []
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = library.encode(r["text"]) if r["text"] else []
        text = library.decode(ids) if ids else ""
        want.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(text.encode()).hexdigest()))
    got = QUERIES["op13_piece_codec"](spark, sf_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(map(tuple, got.collect())) == sorted(want)
