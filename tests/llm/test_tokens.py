import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from fleetwright.llm import common, mixture_pack, token_index
from fleetwright.llm.common import new_folder, span_hashes, spans_equal
from fleetwright.llm.tokens import public_path, word_pieces
from llm.helpers import awkward_rows, docs_of, twin_words

PATH = public_path("word_bpe_49k.json")


def whole(text):
    return word_pieces(PATH).tokenizer.encode(text, add_special_tokens=False).ids


def test_pieces_give_the_ids_of_whole_texts():
    rng = random.Random(3)
    alphabet = "aAbBzZ .,;:!?'\"-_09\n\t\r\x0b\x1c\x85\xa0\u2003éÉßΣσς\u0301İıǅ中🙂<|>sltrm"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += [t or "" for _, t, _, _ in awkward_rows()] + ["the,the. it's ΑΣ ΑΣ. e\u0301 E\u0301", "<|endoftext|>", "a\u0301,b"]
    got = word_pieces(PATH).encode([t.encode() for t in texts])
    for text, ids in zip(texts, got, strict=True):
        assert ids.tolist() == whole(text), repr(text)


def test_forgotten_pieces_are_learned_again(monkeypatch):
    monkeypatch.setattr("fleetwright.llm.tokens.KEPT_PIECES", 5)
    texts = [f"some{i} words{i % 3} here" for i in range(50)]
    assert [i.tolist() for i in word_pieces(PATH).encode([t.encode() for t in texts])] == [whole(t) for t in texts]


@pytest.mark.parametrize("values", [1, 7])
def test_pieces_of_equal_hash_keep_their_own_ids(monkeypatch, values):
    """Every piece shares its hash with many others; their bytes tell them apart."""
    from fleetwright.llm import tokens

    real = tokens.span_hashes
    monkeypatch.setattr(tokens, "span_hashes", lambda *a: real(*a) % np.uint64(values) + np.uint64(1))
    encoder = tokens.WordPieces(PATH)
    texts = [f"some{i % 40} words, of {'long' * (i % 7)} text{i}." for i in range(200)] + ["", " ", *twin_words()]
    for part in (texts[:90], texts[90:], texts):
        assert [i.tolist() for i in encoder.encode([t.encode() for t in part])] == [whole(t) for t in part]


def test_an_encoder_goes_with_its_stage():
    def task(batches):
        for batch in batches:
            word_pieces(PATH).encode([b"some words"])
            yield batch

    rows = [pa.RecordBatch.from_pydict({"a": [1]})]
    list(common.lean(task)(rows))
    first = word_pieces(PATH)
    list(common.lean(task)(rows))
    assert word_pieces(PATH) is first  # the next task of a stage that encodes finds it
    list(common.lean(lambda batches: batches)(rows))
    list(common.lean(lambda batches: batches)(rows))
    assert not common._kept


def test_span_hashes_depend_on_every_byte():
    raw = np.random.default_rng(1).integers(0, 256, 400, dtype=np.uint8)
    first = np.array([0, 3, 10, 100, 399, 400])
    last = np.array([3, 10, 26, 399, 400, 400])
    hashes = span_hashes(raw, first, last)
    for i, (a, b) in enumerate(zip(first, last, strict=True)):
        assert span_hashes(raw[a:b].copy(), np.array([0]), np.array([b - a]))[0] == hashes[i]
        for k in range(a, b):
            other = raw.copy()
            other[k] ^= 128
            changed = span_hashes(other, first, last) != hashes
            assert changed[i] and spans_equal(raw, first, last - first, other, first).tolist() == (~changed).tolist()


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 40_000])
def test_perfect_hash_is_minimal_and_answers(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 2**64, n, dtype=np.uint64))
    _, slots, _ = token_index.perfect_hash(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))
    entries = np.zeros(len(keys), token_index.ENTRY)
    entries["print"], entries["offset"] = np.arange(len(keys)), np.arange(len(keys)) * 7
    blob = token_index.pack_bucket(keys, entries)
    out, good = token_index.ask_bucket(blob, keys, np.arange(len(keys), dtype=np.uint32))
    assert good.all() and (out["offset"] == np.arange(len(keys)) * 7).all()
    other = np.random.default_rng(n + 1).integers(0, 2**64, 500, dtype=np.uint64)
    _, good = token_index.ask_bucket(blob, other, np.full(500, 2**32 - 1, np.uint32))
    assert not good.any()


def test_keys_that_share_all_hashes_are_told_apart():
    keys = np.array([5, 5, 9], np.uint64)
    entries = np.zeros(3, token_index.ENTRY)
    entries["print"], entries["offset"] = [1, 2, 3], [10, 20, 30]
    out, good = token_index.ask_bucket(token_index.pack_bucket(keys, entries), keys, np.array([1, 2, 3], np.uint32))
    assert good.all() and out["offset"].tolist() == [10, 20, 30]


def test_indexed_tokens(spark):
    rows = awkward_rows()
    got = token_index.indexed_tokens(docs_of(spark, rows), PATH, end_id=1).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    want, start = [], 0
    for doc_id, text, _, _ in order:
        ids = np.array([*whole(text or ""), 1], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got), key=key) == sorted(want, key=key)


def test_absent_keys_and_empty_tables(spark):
    docs = docs_of(spark, awkward_rows())
    folder = new_folder(spark, "test-shards")
    index = token_index.build_index(token_index.write_shards(docs, folder, PATH, 1))
    asked = spark.createDataFrame([(2, 0), (2, 1), (99, 0), (12, 1)], "doc_id long, copy long")
    assert sorted((r["doc_id"], r["copy"]) for r in token_index.find(asked, index).collect()) == [(2, 0), (12, 1)]
    assert token_index.indexed_tokens(docs_of(spark, []), PATH, 1).collect() == []
    assert mixture_pack.pack(docs_of(spark, []), PATH, 2).collect() == []


def check_pieces(pieces, rows, sequence=mixture_pack.SEQUENCE):
    """Each id in exactly one piece, sequences gapless from 0, all but the last full."""
    ids = {}
    for doc_id, text, _, _ in rows:
        ids.setdefault(doc_id, []).append(np.array([*whole(text or ""), 2], "<u4"))
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault((p["doc_id"], p["doc_tokens"]), []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for (doc_id, n), held in by_doc.items():
        same = [i for i in ids[doc_id] if len(i) == n]
        assert sum(p["length"] for p in held) == n * len(same)
        for p in held:
            assert any(zlib.crc32(i[p["start"]:p["start"] + p["length"]].tobytes()) == p["ids_crc32"] for i in same)
        covered = sorted(x for p in held for x in range(p["start"], p["start"] + p["length"]))
        assert covered == sorted(list(range(n)) * len(same))
    assert sum(map(len, ids.values())) == sum(len(held) and len([i for i in ids[d] if len(i) == n]) for (d, n), held in by_doc.items())
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for number, spans in by_sequence.items():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end and length > 0
            end += length
        assert end == sequence or number == max(by_sequence) and end <= sequence


def test_pack_awkward_rows(spark):
    rows = awkward_rows()
    check_pieces(mixture_pack.pack(docs_of(spark, rows), PATH, 2).collect(), rows)
    small = mixture_pack.pack(docs_of(spark, rows), PATH, 2, targets={"a": 1, "b": 8}, sequence=64, window_sequences=2)
    check_pieces(small.collect(), rows, 64)


@pytest.mark.parametrize("targets", [None, {"s7": 3.0, "s399": 1.0}])
def test_pack_more_sources_than_queues(spark, targets):
    rows = [(i, f"document {i} " + "word " * (i % 23), None, f"s{i % 400}") for i in range(1000)]
    pieces = mixture_pack.pack(docs_of(spark, rows), PATH, 2, targets, sequence=64, window_sequences=4).collect()
    check_pieces(pieces, rows, 64)
    assert {(p["doc_id"], p["source"]) for p in pieces} == {(i, s) for i, _, _, s in rows}


def test_pack_real_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"], None, None) for r in docs.collect()]
    check_pieces(mixture_pack.pack(docs, PATH, 2).collect(), rows)


@pytest.mark.parametrize("targets", [None, {"a": 1.0, "b": 1.0, "c": 1.0, "d": 1.0}, {"a": 5.0, "c": 1.0}])
def test_schedule_keeps_proportions_and_uses_all(targets):
    totals = {"a": 700_001, "b": 31_013, "c": 90_000, "d": 7_003}
    schedule = mixture_pack.Schedule(totals, targets, sequence=64, window_sequences=4)
    used = np.zeros((schedule.windows * 4, 64), np.int64)
    by_window = np.zeros((schedule.windows, 4), np.int64)
    for q, (name, total) in enumerate(sorted(totals.items())):
        at = 0
        while at < total:
            n = min(1777, total - at)
            covered = 0
            for start, length, sequence, offset in schedule.pieces(name, at, n):
                assert start == covered
                covered += length
                used[sequence, offset:offset + length] += 1
                by_window[sequence // 4, q] += length
            assert covered == n
            at += n
    flat = used.ravel()
    assert flat.max() == 1 and flat[:sum(totals.values())].all() and not flat[sum(totals.values()):].any()
    # While all queues that have a target last, every window is filled to the proportions within one token each.
    wanted = np.array([(targets or totals).get(n, 0) for n in sorted(totals)], float)
    share = wanted / wanted.sum() * schedule.window
    for row in by_window[:20]:
        assert (np.abs(row - share) <= 2).all()
    # Accounts are carried: after any number of windows the sum is within two tokens of the target.
    sums = np.cumsum(by_window[:20], axis=0)
    assert (np.abs(sums - share * np.arange(1, 21)[:, None]) <= 2).all()


def test_too_many_queues_are_refused():
    with pytest.raises(ValueError):
        mixture_pack.Schedule({str(i): 1 for i in range(mixture_pack.MAX_QUEUES + 1)})
