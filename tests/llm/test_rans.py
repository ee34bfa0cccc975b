import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanloom.llm import rans
from spanloom.llm.common import WordCodec, scratch

from .cases import ROWS, documents, empty

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(VOCABULARY)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(), max_size=20).map(" ".join))
def test_codec_encodes_as_the_library_does(text):
    whole = Tokenizer.from_file(VOCABULARY)
    assert np.frombuffer(WordCodec(VOCABULARY).encode(text), "<u2").tolist() == whole.encode(text, add_special_tokens=False).ids


SPECIAL = ["<|endoftext|>", "a<|startoftext|>b", "one <|endoftext|> two", "<|endoftext|", "x.<|startoftext|><|endoftext|>"]


@pytest.mark.parametrize("text", SPECIAL)
@pytest.mark.parametrize("literal", [False, True])
def test_special_strings_are_as_the_library_has_them(text, literal):
    whole = Tokenizer.from_file(VOCABULARY)
    whole.encode_special_tokens = literal
    assert np.frombuffer(WordCodec(VOCABULARY, literal).encode(text), "<u2").tolist() == whole.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def codec():
    return WordCodec(VOCABULARY)


@settings(max_examples=500, deadline=None)
@given(text=st.text(st.characters(max_codepoint=0x17F), max_size=40) | st.lists(st.sampled_from(["Word", "WORD,", "À", "J\u030c", "T\u0308", "İ", "ŸÀß", "µ", "<|ENDOFTEXT|>", "<|endoftext|>", "<", "|", "'S", "\xa0", "\x85", " "]), max_size=12).map("".join))
def test_texts_in_lower_case_have_the_librarys_ids(tokenizer, codec, text):
    """One codec for all of them, as a worker has."""
    assert np.frombuffer(codec.encode(text), "<u2").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_a_word_is_kept_once_however_it_is_written():
    codec = WordCodec(VOCABULARY)
    codec.encode("Über über ÜBER word Word WORD, word,")
    assert sorted(codec.kept) == ["", ",", "word", "word,", "über"]


@pytest.mark.parametrize("n", [0, 1, 7, 64, 1000, 5000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    ids = rng.zipf(1.3, n).clip(max=4999).astype(np.uint32)
    coder = rans.Coder(rans.quantized(np.bincount(ids, minlength=5000)), lanes=16, stride=8)
    lengths = np.array([n // 3, n - n // 3], np.uint32)
    out, got = coder.decode(coder.encode(ids, lengths))
    assert out.tolist() == ids.tolist() and got.tolist() == lengths.tolist()


def test_segments_decode_from_their_checkpoint_alone():
    ids = np.arange(1000, dtype=np.uint32) % 50
    coder = rans.Coder(rans.quantized(np.bincount(ids)), lanes=16, stride=8)
    n, _, marks, words = coder.opened(coder.encode(ids, np.array([1000], np.uint32)))
    assert len(marks) == 8
    for k in reversed(range(8)):
        assert coder.segment(n, k, marks[k], words).tolist() == ids[k * 128 : (k + 1) * 128].tolist()


def test_damage_is_noticed():
    ids = np.arange(300, dtype=np.uint32) % 50
    coder = rans.Coder(rans.quantized(np.bincount(ids)), lanes=16, stride=8)
    block = bytearray(coder.encode(ids, np.array([300], np.uint32)))
    block[-9] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        coder.decode(bytes(block))


def test_coding_is_near_the_entropy():
    rng = np.random.default_rng(1)
    ids = rng.choice(256, 200_000, p=np.arange(1, 257) / np.arange(1, 257).sum()).astype(np.uint32)
    p = np.bincount(ids) / len(ids)
    entropy = -(p[p > 0] * np.log2(p[p > 0])).sum() * len(ids) / 8
    assert len(rans.Coder(rans.quantized(np.bincount(ids))).encode(ids, np.array([len(ids)], np.uint32))) < 1.25 * entropy


def test_frequencies_add_up():
    counts = np.zeros(60_000, np.int64)
    counts[:50_000] = 1
    counts[7] = 10**12
    freq = rans.quantized(counts)
    assert freq.sum() == 1 << rans.BITS and (freq[:50_000] >= 1).all() and not freq[50_000:].any()


def test_file_round_trip(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(rans, "BLOCK_TOKENS", 64)
    path = scratch(spark, "test")
    rans.write_tokens(documents(spark).repartition(3), path, VOCABULARY, end_id=2)
    rows = sorted(rans.read_tokens(spark, path).collect(), key=lambda r: r["start"])
    assert len(rows) == len(ROWS)
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    at = 0
    for r, (name, text) in zip(rows, order, strict=True):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4").tolist()) == (name, at, ids)
        at += len(ids)


def test_empty_table(spark):
    path = scratch(spark, "test")
    rans.write_tokens(empty(spark), path, VOCABULARY, end_id=2)
    assert rans.read_tokens(spark, path).count() == 0


def test_query(spark, sf, tokenizer):
    rows = {r["doc_id"]: r for r in rans.op1_rans_tokens(spark, sf).collect()}
    at = 0
    for d in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect():
        ids = np.array([*tokenizer.encode(d["text"], add_special_tokens=False).ids, 2], "<u4")
        r = rows[d["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
