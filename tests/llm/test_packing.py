import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from spanloom.llm import common, packing
from spanloom.llm.common import WordCodec

from .cases import ROWS, documents, empty

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def ids_of(text):
    return np.append(np.frombuffer(WordCodec(VOCABULARY).encode(text), "<u2"), 1).astype("<u4")


@pytest.mark.parametrize("chars", [2_000_000, 20_000])
def test_every_id_lies_in_one_piece(spark, chars):
    rows = packing.packed(documents(spark), VOCABULARY, 1, window=64, shard_chars=chars).collect()
    left = sorted(np.concatenate([ids_of(t) for _, t in ROWS]).tolist())
    texts = {(i, len(ids_of(t))): ids_of(t) for i, t in ROWS}
    got, sequences = [], {}
    for r in rows:
        ids = texts[r["doc_id"], r["doc_tokens"]][r["start"] : r["start"] + r["length"]]
        assert len(ids) == r["length"] > 0 and zlib.crc32(ids.tobytes()) == r["ids_crc32"]
        got += ids.tolist()
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert sorted(got) == left
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    full = sum(sum(n for _, n in p) == 64 for p in sequences.values())
    assert full >= len(sequences) - len({s >> 32 for s in sequences})


def test_neighbours_share_windows():
    a, b = np.arange(100, dtype=np.uint32), np.arange(1000, 1100, dtype=np.uint32)
    docs = [a[:50], b[:50], a[20:70], b[20:70]]
    pieces = packing.pack(docs, window=100)
    by = {}
    for d, _, _, seq, _ in pieces:
        by.setdefault(seq, set()).add(d)
    assert by == {0: {0, 2}, 1: {1, 3}}


def test_near_copies_share_windows_whatever_the_number_of_shards(spark):
    """Pairs of one rare vocabulary each, in a corpus of many shards."""
    rng = np.random.default_rng(9)
    letters = np.array(list("bcdfghjklmnpqrstvwxz"))
    rows = []
    for i in range(60):
        words = ["".join(rng.choice(letters, 6)) for _ in range(60)]
        rows += [(i, " ".join(words)), (1000 + i, " ".join(words[:55] + words[:5]))]
    window = 2 * max(len(ids_of(t)) for _, t in rows)
    got = packing.packed(documents(spark, rows), VOCABULARY, 1, window=window, shard_chars=4000).collect()
    assert len({r["sequence_id"] >> 32 for r in got}) > 8
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add(r["sequence_id"])
    assert sum(bool(by[i] & by[1000 + i]) for i in range(60)) >= 50


def test_ranks_are_bm25():
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 30, rng.integers(5, 40)).astype(np.uint32) for _ in range(20)]
    index, n, mean = packing.Index(docs), len(docs), np.mean([len(d) for d in docs])

    def score(q, d):
        out = 0.0
        for t in set(q.tolist()):
            tf, df = (d == t).sum(), sum((x == t).any() for x in docs)
            out += np.log1p((n - df + 0.5) / (df + 0.5)) * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(d) / mean)) if tf else 0
        return out

    for q in range(5):
        want = [score(docs[q], d) for d in docs]
        got = [want[i] for i in index.ranked(q)]
        assert np.allclose(got, sorted(want, reverse=True))


def test_signs_are_drawn_once_in_a_process():
    assert packing.signs() is packing.signs()
    assert packing.signs().nbytes <= 8 << 20 and set(np.unique(packing.signs()).tolist()) == {-1, 1}


def test_workers_that_place_documents_keep_no_words():
    common.codec(VOCABULARY).encode("some words")
    packing.signs()
    assert list(common._state) == ["signs"]


def test_a_task_packs_many_shards(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(40))) for i in range(200)]
    got = packing.packed(documents(spark, rows), VOCABULARY, 1, shard_chars=1000)
    assert got.rdd.getNumPartitions() <= 4
    rows = got.collect()
    assert len({r["sequence_id"] >> 32 for r in rows}) > 16 and len({r["doc_id"] for r in rows}) == 200


def test_texts_encoded_together_are_as_encoded_alone():
    odd = [None, "", " ", "  a  b ", "word. Word, WORD!?", "\u00c9t\u00e9... \u00df;", "e\u0301 A\u0308.", "\u4e2d\u6587\uff0c\ud83d\ude00".encode("utf-16", "surrogatepass").decode("utf-16"), "<|endoftext|> A", "x\ty\r\nz\0q", "...", "a.b, 3,000 \u00aa\u00b5.", "\u0130 I", "y" * 5000 + "."]
    texts = odd + [t for _, t in ROWS] + odd
    whole = Tokenizer.from_file(VOCABULARY)
    want = [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    of = WordCodec(VOCABULARY)
    assert [np.frombuffer(x, "<u2").tolist() for x in of.encode_all(texts)] == want
    assert [np.frombuffer(of.encode(t), "<u2").tolist() for t in texts] == want
    assert of.encode_all([None, ""]) == [b"", b""] and of.encode_all([]) == []


def test_empty_table(spark):
    assert packing.packed(empty(spark), VOCABULARY, 1).count() == 0
