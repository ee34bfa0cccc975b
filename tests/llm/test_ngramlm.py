import math
from collections import Counter

import numpy as np
import pytest

from spanloom.llm import ngramlm

from .cases import ROWS, documents, empty


def brute(texts, order, alpha, leave_out):
    split = [(t or "").encode().split() for t in texts]
    grams = lambda w, n: [tuple(w[i - n + 1 : i + 1]) for i in range(n - 1, len(w))]
    counts = [Counter(g for w in split for g in grams(w, n)) for n in range(order + 1)]
    total = sum(map(len, split))
    out = []
    for w in split:
        own = [Counter(grams(w, n)) if leave_out else Counter() for n in range(order + 1)]
        c = lambda n, g: counts[n][g] - own[n][g]  # noqa: B023, E731
        score = short = 0
        for i in range(len(w)):
            most = used = min(i + 1, order)
            while used > 1 and c(used, tuple(w[i - used + 1 : i + 1])) < 1:
                used -= 1
            top = c(used, tuple(w[i - used + 1 : i + 1]))
            score += math.log(max(1, top) / (c(used - 1, tuple(w[i - used + 1 : i])) if used > 1 else total)) + (most - used) * math.log(alpha)
            short += used < most
        out.append((len(w), short, score))
    return out


@pytest.mark.parametrize(("order", "leave_out", "docs"), [(1, True, 1000), (2, True, 1000), (3, True, 2), (3, False, 1000), (4, True, 1000)])
def test_against_brute_force(spark, monkeypatch, order, leave_out, docs):
    monkeypatch.setattr(ngramlm, "BLOCK_WORDS", 500)
    monkeypatch.setattr(ngramlm, "BLOCK_DOCS", docs)
    monkeypatch.setattr(ngramlm, "BUCKET_WORDS", 2000)
    monkeypatch.setattr(ngramlm, "BUCKET_CHARS", 50_000)
    rows = ngramlm.backoff_scores(documents(spark).repartition(3), order, leave_out=leave_out).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:3], round(r[3], 6))
    want = [(i, *x) for (i, _), x in zip(ROWS, brute([t for _, t in ROWS], order, 0.4, leave_out), strict=True)]
    got = [(r["doc_id"], r["n_words"], r["n_backoff"], r["score"]) for r in rows]
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-6
    assert not spark.catalog.listTables("default", "lm_blocks_*")


def test_packed_integers():
    for a in ([], [0], [1, 255, 256], [2**40, 3], list(range(1000))):
        assert ngramlm.unpack(ngramlm.pack(np.array(a, np.uint64))).tolist() == a


def test_empty_table(spark):
    assert ngramlm.backoff_scores(empty(spark)).count() == 0
