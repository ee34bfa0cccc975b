import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spanloom.llm import simhash

from .cases import LONG, PROSE, ROWS, documents, empty


def plain(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(ids, fps, most):
    names = list(range(len(fps)))
    root = lambda i: i if names[i] == i else root(names[i])
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                a, b = root(i), root(j)
                names[max(a, b)] = min(a, b)
    low = {}
    for i, name in enumerate(ids):
        if name is not None:
            low[root(i)] = min(name, low.get(root(i), name))
    return [low.get(root(i)) for i in range(len(ids))]


@pytest.mark.parametrize("text", [t for _, t in ROWS] + ["A b c D", "one two three four five"])
def test_fingerprint(text):
    assert int.from_bytes(simhash.fingerprint(text, 4)) == plain(text, 4)


def test_cases(spark):
    rows = simhash.simhash_components(documents(spark), words=4, width=1, max_bits=4).collect()
    fps = [plain(t, 4) for _, t in ROWS]
    want = sorted((str(i), c) for (i, _), c in zip(ROWS, classes([i for i, _ in ROWS], fps, 4), strict=True))
    assert sorted((str(r["doc_id"]), r["component_id"]) for r in rows) == want


@pytest.mark.parametrize("chunk", [1024, 8])
def test_links_lose_nothing(spark, monkeypatch, chunk):
    """Clouds of fingerprints a few bits from their middle, some dense enough for hot buckets."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = np.random.default_rng(5)
    fps = []
    for size in (1, 2, 5, 60):
        middle = int(rng.integers(0, 2**63))
        for _ in range(size):
            x = middle
            for b in rng.choice(64, rng.integers(0, 4), replace=False):
                x ^= 1 << int(b)
            fps.append(x)
    fps = sorted(set(fps))
    frame = spark.createDataFrame([(bytearray(f.to_bytes(8)),) for f in fps], "fp binary")
    edges = simhash.links(frame, 1, 4)
    assert all((int.from_bytes(r["a"]) ^ int.from_bytes(r["b"])).bit_count() <= 4 for r in edges.collect())
    found = {int.from_bytes(r["node"]): int.from_bytes(r["root"]) for r in simhash.components(edges).collect()}
    want = classes(fps, fps, 4)
    assert [found.get(f, f) for f in fps] == want


def test_pivots_never_discard_a_link():
    rng = np.random.default_rng(6)
    a = rng.integers(0, 2**63, (500, 1)).astype(np.uint64)
    b = a ^ (np.uint64(1) << rng.integers(0, 63, (500, 1)).astype(np.uint64)) ^ np.uint64(3)
    assert (np.abs(simhash.pivot_table(a) - simhash.pivot_table(b)).max(axis=1) <= np.bitwise_count(a ^ b)[:, 0]).all()


def test_pivots_discard_most_pairs_and_no_link():
    """Of the pairs in buckets of random fingerprints, and of clouds around some."""
    rng = np.random.default_rng(12)
    fps = rng.integers(0, 2**63, (600, 1)).astype(np.uint64)
    fps[300:400] = fps[:100] ^ np.uint64(0b1011)
    group = np.repeat(np.arange(3), 200)
    group[300:400], group[:100] = 0, 0
    order = np.argsort(group, kind="stable")
    group, fps = group[order], fps[order]
    seen = [0, 0]
    pairs = simhash.forest(group, fps, simhash.pivot_table(fps), 4, seen)
    assert len(pairs) == 100 and all(np.bitwise_count(fps[i] ^ fps[j])[0] <= 4 for i, j in pairs)
    assert seen[1] < 0.05 * seen[0]


@pytest.mark.parametrize("classes_", [1000, 10**9, 10**12])
def test_equal_blocks_are_keys_of_every_link(classes_):
    sets = simhash.bit_sets(1, 4, 0.8, 0.99, classes_)
    rng = np.random.default_rng(13)
    for _ in range(200):
        differ = np.zeros(64, bool)
        differ[rng.choice(64, 4, replace=False)] = True
        assert any(not differ[s].any() for s in sets)
    assert min(map(len, sets)) >= min(32, np.log2(classes_) - 7)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {**dict.fromkeys(range(1, 61), 0), 101: 100}


def test_deduplicated_keeps_one_of_each_group_and_all_columns(spark):
    words = LONG.split()[:400]
    near = words[:200] + ["changed"] + words[201:]
    rows = [*ROWS, (20, " ".join(words)), (21, " ".join(near)), (22, " ".join(reversed(words))), (None, PROSE)]
    docs = documents(spark, rows)
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    assert "20" in ids and "21" not in ids and "22" in ids and ids.count("1") == 1 and "6" not in ids and ids.count("None") == 2


def test_rows_that_share_an_id_but_not_a_text_are_documents_of_their_own(spark):
    other = " ".join(f"other{i}" for i in range(80))
    kept = simhash.deduplicated(documents(spark, [(1, PROSE), (2, PROSE), (2, other), (2, other)])).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == [(1, PROSE), (2, other)]


def test_empty_table(spark):
    assert simhash.simhash_components(empty(spark)).count() == 0
    assert simhash.deduplicated(empty(spark)).count() == 0


def test_near_copies_at_the_threshold(spark):
    """Pairs of five-word-shingle similarity 0.85 or more are found, unrelated texts aren't."""
    rng = np.random.default_rng(7)
    rows = []
    for i in range(60):
        words = [f"t{rng.integers(0, 5000)}" for _ in range(300)]
        other = list(words)
        for at in (60, 150, 240, 290)[: 1 + i % 4]:
            other[at] = "zzz"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    got = simhash.deduplicated(documents(spark, rows)).select(F.col("doc_id")).collect()
    ids = {r["doc_id"] for r in got}
    assert {2 * i for i in range(60)} <= ids and len(ids) <= 62


@pytest.mark.parametrize(("chunk", "dense"), [(1024, 4000), (8, 4000), (1024, 0)])
def test_verified_groups_are_those_of_the_exact_similarity(spark, monkeypatch, chunk, dense):
    """Copies with one to many changed words: groups hold what 0.8 links and nothing below it."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    monkeypatch.setattr(simhash, "DENSE", dense)
    rng = np.random.default_rng(8)
    rows = []
    for g in range(6):
        words = [f"t{rng.integers(0, 9000)}" for _ in range(250)]
        for _ in range(12):
            copy = list(words)
            for at in rng.choice(250, rng.integers(0, 14), replace=False):
                copy[at] = f"new{rng.integers(0, 10**9)}"
            rows.append((len(rows), " ".join(copy)))
    sets = [set(simhash.shingles(t, 5).tolist()) for _, t in rows]
    names = list(range(len(rows)))
    root = lambda i: i if names[i] == i else root(names[i])
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                names[max(a, b)] = min(a, b)
    got = {r["doc_id"]: r["component_id"] for r in simhash.simhash_components(documents(spark, rows), **simhash.PIPELINE).collect()}
    assert [got[i] for i in range(len(rows))] == [root(i) for i in range(len(rows))]
    assert 6 < len(set(got.values())) < 60


@pytest.mark.parametrize("documents_", [10_000, 1_000_000, 30_000_000])
def test_recall_at_the_threshold_does_not_depend_on_the_number_of_classes(documents_):
    """Pairs planted at similarity 0.80 to 0.82 meet in a table of keys within max_bits."""
    rng = np.random.default_rng(10)
    pairs = []
    for _ in range(1200):
        words = [f"t{x}" for x in rng.integers(0, 10**9, 300)]
        other = list(words)
        for at in range(20, 300, 50):
            other[at] = "zzz"
        a, b = (set(simhash.shingles(" ".join(w), 5).tolist()) for w in (words, other))
        assert 0.8 <= len(a & b) / len(a | b) <= 0.82
        pairs.append([np.unpackbits(np.frombuffer(simhash.fingerprint(" ".join(w), 5, 4), np.uint8)) for w in (words, other)])
    differ = np.array([a ^ b for a, b in pairs])
    met = np.zeros(len(pairs), bool)
    for s in simhash.bit_sets(4, 56, 0.8, 0.99, documents_):
        met |= ~differ[:, s].any(axis=1)
    assert (met & (differ.sum(axis=1) <= 56)).mean() >= 0.985


def test_texts_of_equal_fingerprints_have_names_of_their_own(monkeypatch):
    monkeypatch.setattr(simhash, "voted", lambda h, width: bytes(8 * width))
    a, b = (" ".join(f"{k}w{i}" for i in range(100)) for k in "ab")
    assert simhash.named(a, 5, 4) != simhash.named(b, 5, 4)
    assert simhash.named(a, 5, 4) == simhash.named(a.upper(), 5, 4)


def test_a_long_run_of_one_token_makes_no_near_duplicate(spark):
    rows = [(k, " ".join(["0"] * 524 + [f"{k}w{i}" for i in range(500)])) for k in range(3)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.simhash_components(documents(spark, [*rows, (9, rows[0][1])]), **simhash.PIPELINE).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 9: 0}


def test_a_passage_repeated_in_one_copy_does_not_hide_it(spark):
    """The same sets of shingles but for the joints; one passage is 20 times in the copy."""
    rng = np.random.default_rng(11)
    rows = []
    for g in range(10):
        words = [f"t{x}" for x in rng.integers(0, 10**9, 300)]
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(words[:160] + words[100:160] * 19 + words[160:]))]
    got = {r["doc_id"]: r["component_id"] for r in simhash.simhash_components(documents(spark, rows), **simhash.PIPELINE).collect()}
    assert got == {i: i // 2 * 2 for i in range(20)}
