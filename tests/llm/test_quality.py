import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import quality
from spanloom.llm.common import drawn

from .cases import ROWS, documents, empty


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_ftrl_separates():
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(400):
        y = int(rng.integers(0, 2))
        rows.append((y, np.sort(rng.choice(50, 5, replace=False)) + 50 * y, np.full(5, 0.5)))
    w, bias = quality.train(rows)
    logits = np.array([bias + w[a] @ x for _, a, x in rows])
    assert ((logits > 0) == np.array([y for y, _, _ in rows])).mean() > 0.98
    assert not w[1000:].any()


def test_ftrl_is_the_plain_per_coordinate_rule():
    """Against the update written out for one coordinate at a time."""
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(0, 2)), np.sort(rng.choice(40, 6, replace=False)), rng.random(6)) for _ in range(60)]
    z, n = {}, {}
    bias = 1 << quality.HASH_BITS

    def weight(i):
        if abs(z.get(i, 0.0)) <= quality.L1:
            return 0.0
        sign = 1 if z[i] > 0 else -1
        return -(z[i] - sign * quality.L1) / ((quality.BETA + n[i] ** 0.5) / quality.ALPHA + quality.L2)

    for _ in range(2):
        for y, at, x in rows:
            some = [*zip(at.tolist(), x.tolist(), strict=True), (bias, 1.0)]
            w = {i: weight(i) for i, _ in some}
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in some)))
            for i, v in some:
                g = (p - y) * v
                sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / quality.ALPHA
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    got, b = quality.train(rows, 2)
    assert abs(b - weight(bias)) < 1e-9 and all(abs(got[i] - weight(i)) < 1e-9 for i in range(40))


def test_labels_that_disagree(spark):
    """The smallest label of a doc_id counts, in any order of rows."""
    docs = documents(spark)
    rows = [(1, 1, 0), (8, 0, 0), (9, 1, 0), (5, 0, 0)]
    models = [quality.fitted(docs, labels(spark, some).repartition(k + 1), F.lit(True)) for k, some in enumerate(([*rows, (1, 0, 0)], [(1, 0, 0), *reversed(rows)]))]
    once = quality.fitted(docs, labels(spark, [(1, 0, 0), *rows[1:]]), F.lit(True))
    assert all((m[0] == once[0]).all() and m[1] == once[1] for m in models)


@pytest.mark.parametrize("n", [10, 10**7, 10**10, 10**13])
def test_the_share_that_is_drawn_holds_at_any_size(spark, n):
    """Of 200,000 hashes, taken as all that lie below a small share of n rows."""
    wanted = 6000
    rows = spark.range(200_000).select(F.xxhash64("id").alias("h"))
    scale = max(1, n // 200_000)
    below = rows.select((F.shiftrightunsigned(F.col("h"), 2) / scale).cast("long").alias("h"))
    got = below.filter(drawn(F.col("h"), wanted, n)).count()
    want = 200_000 * min(1, wanted / n * scale)
    assert abs(got - want) <= 6 * want**0.5 + 1


def test_score_is_the_dot_product():
    of, w = quality.Features(), np.random.default_rng(1).normal(size=1 << quality.HASH_BITS)
    for _, t in ROWS:
        at, x = of.vector(t)
        want = 1 / (1 + np.exp(-np.clip(0.3 + w[at] @ x, -35, 35)))
        assert abs(quality.score_of(of, t, w, 0.3) - want) < 1e-9


def test_cases(spark):
    model = quality.fitted(documents(spark), labels(spark, [(1, 1, 0), (8, 0, 0), (9, None, 0), (None, 1, 0), (6, 1, 1), (99, 0, 0)]), F.lit(True))
    rows = quality.scored(documents(spark), model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    by = {r["doc_id"]: r["score"] for r in rows}
    assert by[2] == by[3] == by[4] and by[1] > by[8]
    docs = documents(spark)
    assert quality.keep_good(docs, model).schema == docs.schema
    assert quality.scored(empty(spark), model).count() == 0
    none = quality.fitted(documents(spark), labels(spark, []), F.lit(True))
    assert {r["score"] for r in quality.scored(documents(spark), none).collect()} == {0.5}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = quality.op10_ftrl_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out")
    right, n = got.agg(F.count_if(F.col("predicted") == F.col("quality")), F.count("*")).first()
    assert n > 50 and right / n > 0.97
