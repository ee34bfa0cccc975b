import itertools
from collections import Counter

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from spanloom.llm import langid

from .cases import documents, empty

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


def test_forward_sums_all_segmentations():
    pieces = sorted(["▁", "▁a", "a", "b", "ab", "ba", "▁ab"])
    index = {p: i for i, p in enumerate(pieces)}
    p = np.random.default_rng(3).random(len(pieces) + 1)
    words = ["abba", "a", "bab", "axb"]

    def brute(word):
        total, s = 0.0, langid.START + word
        for cuts in itertools.product((0, 1), repeat=len(s) - 1):
            at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(s)]
            prob = 1.0
            for a, b in itertools.pairwise(at):
                prob *= p[index[s[a:b]]] if s[a:b] in index else p[-1] if b - a == 1 else 0
            total += prob
        return total

    got = langid.Lattices(words, langid.Pieces(pieces)).likelihood(p)
    assert np.allclose(got, [brute(w) for w in words])


def test_expected_uses_match_numeric_derivative():
    pieces = sorted(["▁", "▁a", "a", "b", "ab", "ba"])
    lattice = langid.Lattices(["abba", "bab"], langid.Pieces(pieces))
    p, n = np.full(len(pieces) + 1, 0.2), np.array([3.0, 1.0])
    got = lattice.expected(p, n)
    for i in range(len(p)):
        up = p.copy()
        up[i] *= 1 + 1e-6
        slope = (n * (np.log(lattice.likelihood(up)) - np.log(lattice.likelihood(p)))).sum() / 1e-6
        assert abs(slope - got[i]) < 1e-3


def test_learning_raises_likelihood_and_tells_languages_apart():
    counts = {"en": Counter({"the": 50, "house": 5, "and": 30, "thing": 9}), "de": Counter({"der": 50, "haus": 5, "und": 30, "ding": 9})}
    model = langid.learnt(counts, langid.pieces_of(VOCABULARY))
    scorer = langid.Scorer(list(model), langid.pieces_of(VOCABULARY), np.stack([*model.values()]))
    assert [x for x, _ in scorer.predict(["the thing and the house", "und das ding der", None, "", "123 !!"])] == ["en", "de", "und", "und", "und"]
    assert all(0 <= s <= 1 for _, s in scorer.predict(["the", "der", None]))


def test_cases(spark):
    model = langid.fitted(documents(spark), F.lit(True), VOCABULARY)
    rows = langid.identified(documents(spark), model).collect()
    assert len(rows) == 15
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["lang_pred"] == by[3]["lang_pred"] == by[8]["lang_pred"] == "und" and by[8]["score"] == 0
    assert by[9]["lang_pred"] in ("en", "fr") and 0 <= by[9]["score"] <= 1
    assert langid.identified(empty(spark), model).count() == 0
    nothing = langid.fitted(empty(spark), F.lit(True), VOCABULARY)
    assert {r["lang_pred"] for r in langid.identified(documents(spark), nothing).collect()} == {"und"}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = langid.op2_unigram_langid(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out")
    right, n = got.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert n > 100 and right / n > 0.97
