import hashlib
import re

import pytest
from pyspark.sql import functions as F

from spanloom.llm import mixing

from .cases import ROWS, documents, empty


def plain_targets(sizes, weights=(5.0, 2.0, 1.0), repeats=3):
    """Targets by the rule as it reads: share by weight, stop at the cap, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    cap, got, left = {s: repeats * sizes[s] for s in names}, dict.fromkeys(names, 0.0), float(sum(sizes.values()))
    open_ = [s for s in names if cap[s] > 0]
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        shares = {s: left * weight[s] / total for s in open_}
        left = 0.0
        for s in open_:
            take = min(shares[s], cap[s] - got[s])
            got[s] += take
            left += shares[s] - take
        open_ = [s for s in open_ if got[s] < cap[s] - 1e-9]
    return got


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 5, None: 200}, {"x": 7}, {"a": 0, "b": 50, "c": 1}, {f"s{i}": (i * 37) % 91 for i in range(40)}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(k, v, 1) for k, v in sizes.items()], "source string, source_size long, docs long")
    got = {r["source"]: r["target"] for r in mixing.targets(rows).collect()}
    want = plain_targets(sizes)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_mix_against_brute_force(spark):
    rows = mixing.mixed(documents(spark)).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = {}
    for n, (i, t) in enumerate(ROWS):
        sources.setdefault(["a", None, "b"][n % 3], []).append((hashlib.md5(str("" if i is None else i).encode()).hexdigest(), i is not None, i or 0, size(t), i))
    goal = plain_targets({s: sum(d[3] for d in docs) for s, docs in sources.items()})
    want = []
    for s, docs in sources.items():
        total, at = sum(d[3] for d in docs), 0
        for _, _, _, n, i in sorted(docs):
            want.append((i, n, total, sum(max(0, min(n, int(goal[s] + 1e-9) - at - k * total)) for k in range(3))))
            at += n
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r["doc_id"], r["size"], r["source_size"], r["taken"]) for r in rows), key=key) == sorted(want, key=key)
    assert all((r["position"] is None) == (r["taken"] == 0) for r in rows)
    assert all(r["taken"] <= 3 * r["size"] and 0 <= c["position"] <= 1 for r in rows for c in r["copies"])


def test_positions_invert_the_schedule(spark):
    rows = spark.range(11).select((F.col("id") / 10).alias("due")).crossJoin(spark.createDataFrame([(-0.8,), (0.0,), (0.8,)], "tilt double"))
    for r in rows.withColumn("t", mixing.position(F.col("due"), F.col("tilt"))).collect():
        assert abs((1 - r["tilt"]) * r["t"] + r["tilt"] * r["t"] ** 2 - r["due"]) < 1e-9


def test_many_documents_in_one_source(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("source"))
    sums = mixing.mixed(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 1 for r in sums) and 15000 - sum(r["taken"] for r in sums) <= 2


def test_training_order_repeats_whole_documents(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "small" if i < 4 else "z", 9.0) for i in range(100)], "doc_id long, text string, source string, position double")
    rows = mixing.training_order(docs).collect()
    assert rows[0].asDict().keys() == {"doc_id", "text", "source", "position"}
    small = [r["doc_id"] for r in rows if r["source"] == "small"]
    assert sorted(small) == sorted([0, 1, 2, 3] * 3)


def test_null_and_shared_ids_follow_the_plan(spark):
    """A source of rows without an id that the plan takes three times, one that it cuts, and rows that share an id."""
    rows = [(None, f"w {i} " * 5, "a") for i in range(3)] + [(7, f"x {i} " * 50, "b") for i in range(40)] + [(8, "y " * 30, "b")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [(r["doc_id"], r["text"]) for r in mixing.training_order(docs).collect()]
    size = lambda t: len(t.split())
    total = sum(size(t) for _, t, _ in rows)
    assert sorted(t for i, t in got if i is None) == sorted([f"w {i} " * 5 for i in range(3)] * 3)
    assert abs(sum(size(t) for _, t in got) - total) <= 100
    assert len({t for i, t in got if i == 7}) > 30


def test_the_schedule_decides_the_order(spark):
    """Other tilts, other positions: a source whose weight falls comes earlier on average than one whose weight rises."""
    docs = spark.createDataFrame([(i, "w " * 10, "ab"[i % 2]) for i in range(400)], "doc_id long, text string, source string")

    def mean(tilts):
        rows = mixing.mixed(docs, tilts=tilts).filter("taken > 0").groupBy("source").agg(F.avg("position").alias("at")).collect()
        return {r["source"]: r["at"] for r in rows}

    falls, rises = mean((-0.8, 0.8)), mean((0.8, -0.8))
    assert falls["a"] + 0.1 < rises["a"] and rises["b"] + 0.1 < falls["b"]


def test_empty_table(spark):
    assert mixing.mixed(empty(spark)).count() == 0
    assert mixing.training_order(empty(spark)).count() == 0


def test_main_path_is_native(spark):
    plan = mixing.mixed(documents(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
