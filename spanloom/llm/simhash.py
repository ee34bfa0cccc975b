"""Operator 5: SimHash near-duplicates found with pivot distance tables.

Fingerprints: the majority bits of the XXH64 hashes (seed 42) of word shingles, ``64 * width`` bits
(where similarity is verified, of the distinct ones, of which the similarity is).
Equal fingerprints collapse into one class first (where similarity is verified, only those of equal shingle sets:
a digest of the set follows the fingerprint in the class's name). Then

1. every class gets its row of the pivot table: Hamming distances to PIVOTS reference fingerprints (those of 64 bits once,
   before they go to their buckets);
2. classes meet in buckets. For few allowed bits these are pigeonhole keys (of ``max_bits + k`` bit blocks at
   least k are equal in a linked pair, so some k equal blocks are a key of both: no link is lost; k grows with
   the number of classes, so that buckets don't). For many allowed bits they are keys of sampled bits, as many tables as reach
   ``recall`` over all pairs at the similarity asked for, whose distances spread, at any number of classes. A pivot table alone would need all pairs;
3. in a bucket, sorted by the first pivot's distance, a pair is discarded as soon as any coordinate
   differs by more than max_bits (triangle inequality); the survivors' distance is verified exactly;
4. a bucket gives only the links that join its parts (a spanning forest), never all its pairs. Buckets of
   more than CHUNK classes are dealt out as pairs of chunks, so that none is held in one task;
5. links become components by alternating large and small stars, one written table a round;
6. where a similarity is asked for (``verify``), those components only say which texts may belong together:
   their shingle sets meet, again in chunks, links of which the Jaccard similarity reaches it remain, and
   components are formed anew.

Defined cases: null or empty text has fingerprint zero and links like any other; null doc_id takes no part
in the choice of the smallest, so a component without any other has a null id; repeated rows are documents
of their own; a very long text is read whole; ties have no part (a component is named by its smallest id); an
empty table gives an empty result; other columns are ignored, or kept by ``deduplicated``, whatever their names
(names that begin with ``__sim_`` are its own).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, partitions, release, runs, slices

PIVOTS, CHUNK, LARGE = 16, 1024, 1 << 16
#: Pairs from which on, and entries up to which, common shingles come from one matrix product.
DENSE, MATRIX = 4000, 20_000_000


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th further 64-bit hash of hashes h; the 0th is h."""
    if not k:
        return h
    x = h + np.uint64((0x9E3779B97F4A7C15 * k) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """The hashes of a text's shingles, repeats included; the whole text if it has fewer words, none if it has no word."""
    from xxhash import xxh64_intdigest

    parts = (text or "").encode().lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    line = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxh64_intdigest(line, 42)], np.uint64)
    ends = list(accumulate(len(w) + 1 for w in parts))
    pieces = [line[a : b - 1] for a, b in zip([0, *ends], ends[words - 1 :], strict=False)]
    return np.fromiter(map(xxh64_intdigest, pieces, repeat(42)), np.uint64, len(pieces))


def fingerprint(text: str | None, words: int, width: int = 1) -> bytes:
    """Big-endian bytes of the fingerprint."""
    return voted(shingles(text, words), width)


def voted(h: np.ndarray, width: int) -> bytes:
    """The majority bits of hashes h."""
    n = len(h)
    if not n:
        return bytes(8 * width)
    votes = np.zeros((width, 64), np.int64)
    for at in range(0, n, LARGE):
        some = h[at : at + LARGE]
        for k in range(width):
            votes[k] += np.unpackbits(mixed(some, k).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * votes > n, axis=1).tobytes()


def named(text: str | None, words: int, width: int) -> bytes:
    """The fingerprint of the shingle set, without repeats, and a digest of it: texts of the same name have similarity 1."""
    from xxhash import xxh3_64_digest

    h = np.unique(shingles(text, words))
    return voted(h, width) + xxh3_64_digest(h.astype("<u8").tobytes())


def fingerprints(docs: DataFrame, words: int, width: int = 1, id_col: str = "doc_id", text_col: str = "text", sets: bool = False) -> DataFrame:
    """doc_id, text_hash, fp (binary) of every whole text; with ``sets``, a digest of its shingle set follows in fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = [(named if sets else fingerprint)(t, words, width) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints, pa.binary())], ["doc_id", "text_hash", "fp"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp binary")


@cache
def pivots(width: int) -> np.ndarray:
    """Reference fingerprints, the same everywhere."""
    return mixed(np.arange(1, PIVOTS * width + 1, dtype=np.uint64), 7).reshape(PIVOTS, width)


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Distances of each fingerprint (a row of 64-bit words) to each pivot."""
    return np.stack([np.bitwise_count(fps ^ p).sum(axis=1, dtype=np.int16) for p in pivots(fps.shape[1])], axis=1)


def found_share(bits: int, r: int, tables: int, max_bits: int, similarity: float) -> float:
    """The share of pairs at this similarity that meet in a table of r sampled bits, over the (binomial) spread of their distances."""
    differ = math.acos(2 * similarity / (1 + similarity)) / math.pi
    out = 0.0
    for d in range(max_bits + 1):
        meet = math.comb(bits - d, r) / math.comb(bits, r)
        out += math.comb(bits, d) * differ**d * (1 - differ) ** (bits - d) * (1 - (1 - meet) ** tables)
    return out


def bit_sets(width: int, max_bits: int, similarity: float, recall: float, classes: int) -> list[list[int]]:
    """The bits of each table's key."""
    bits = 64 * width
    if math.comb(max_bits + 2, 2) <= 32:
        equal = next((k for k in (2, 3) if bits * k // (max_bits + k) >= math.log2(max(2, classes)) - 6), 4)
        blocks = max_bits + equal
        cut = [bits * i // blocks for i in range(blocks + 1)]
        return [[x for b in some for x in range(cut[b], cut[b + 1])] for some in combinations(range(blocks), equal)]
    # Some 16 unrelated classes a bucket: each bit less takes a sixth of the tables, and so of the rows to shuffle.
    r = min(40, max(10, math.ceil(math.log2(max(2, classes)) - 4)))
    tables = 1
    while found_share(bits, r, tables, max_bits, similarity) < recall:
        tables += 1 + tables // 100
        if tables > 1 << 18:
            raise ValueError("no number of key tables reaches this recall within max_bits")
    rng = np.random.default_rng(42)
    return [sorted(rng.choice(bits, r, replace=False).tolist()) for _ in range(tables)]


def with_pivots(classes: DataFrame, width: int) -> DataFrame:
    """classes (fp) with near: the class's row of the pivot table, a byte a pivot.

    Wide fingerprints leave it empty: they have a hundred keys a class, with each of which it would be shuffled, and
    buckets compute it from the fingerprint that they get.
    """
    if width > 1:
        return classes.select("fp", F.lit(b"").alias("near"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            if batch.num_rows:
                fps = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(batch.num_rows, -1).copy().view(">u8").astype(np.uint64)[:, :width]
                near = pivot_table(fps).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in near], pa.binary())], ["fp", "near"])

    return classes.select("fp").mapInArrow(run, "fp binary, near binary")


def keyed(classes: DataFrame, sets: list[list[int]]) -> DataFrame:
    """bucket, fp, near: a row for each class and table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            if not batch.num_rows:
                continue
            fp = batch.column(0)
            bits = np.unpackbits(np.frombuffer(b"".join(fp.to_pylist()), np.uint8).reshape(batch.num_rows, -1), axis=1)
            for t, s in enumerate(sets):
                key = bits[:, s].astype(np.int64) @ (1 << np.arange(len(s), dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array((np.int64(t) << np.int64(44)) | key), fp, batch.column(1)], ["bucket", "fp", "near"])

    return classes.select("fp", "near").mapInArrow(run, "bucket long, fp binary, near binary")


def forest(group: np.ndarray, fps: np.ndarray, table: np.ndarray, max_bits: int, seen: list[int] | None = None) -> list[tuple[int, int]]:
    """Row pairs, at most max_bits apart, that join the parts of each group; rows come sorted by group, each with its
    row of the pivot table. ``seen`` gets how many pairs there were, and how many were left to verify."""
    order = np.lexsort((table[:, 0], group))
    group, fps, table = group[order], fps[order], table[order]
    parent, found = np.arange(len(group)), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    near = np.arange(len(group))
    for s in range(1, len(group)):
        near = near[near < len(group) - s]
        near = near[(group[near] == group[near + s]) & (table[near + s, 0] - table[near, 0] <= max_bits)]
        if not len(near):
            break
        left = near
        for k in range(1, PIVOTS):
            left = left[np.abs(table[left, k] - table[left + s, k]) <= max_bits]
        if seen is not None:
            seen[0] += int((group[s:] == group[:-s]).sum())
            seen[1] += len(left)
        left = left[np.bitwise_count(fps[left] ^ fps[left + s]).sum(axis=1) <= max_bits]
        left = left[parent[left] != parent[left + s]]
        for i in left.tolist():
            if (a := root(i)) != (b := root(i + s)):
                parent[max(a, b)] = min(a, b)
                found.append((int(order[i]), int(order[i + s])))
        if len(left):
            while (parent != (up := parent[parent])).any():
                parent = up
    return found


def links(classes: DataFrame, width: int, max_bits: int, similarity: float = 0.8, recall: float = 0.99) -> DataFrame:
    """a, b (fingerprints): links that connect exactly the classes that pairs at most max_bits apart connect."""
    spark = classes.sparkSession
    classes = with_pivots(classes, width)
    rows = celled(keyed(classes, bit_sets(width, max_bits, similarity, recall, classes.count())), "bucket")

    held_pivots = PIVOTS if width == 1 else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def joined(group: np.ndarray, raw: np.ndarray) -> pa.RecordBatch:
            names = np.ascontiguousarray(raw[:, : raw.shape[1] - held_pivots])
            fps = names.view(">u8").astype(np.uint64).reshape(len(group), -1)[:, :width]
            pairs = forest(group, fps, raw[:, -PIVOTS:].astype(np.int16) if held_pivots else pivot_table(fps), max_bits)
            return edges_of([r.tobytes() for r in names], pairs)

        for batch in slices(batches, 8192):
            if not batch.num_rows:
                continue
            raw = np.frombuffer(b"".join(x + y for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)), np.uint8).reshape(batch.num_rows, -1)
            key = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
            if held:
                key, raw = np.concatenate([held[0], key]), np.concatenate([held[1], raw])
            new = np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])
            last = int(np.flatnonzero(new)[-1])
            held = key[last:], raw[last:]
            if last:
                yield joined(np.cumsum(new[:last]), np.ascontiguousarray(raw[:last]))
        if held:
            yield joined(np.zeros(len(held[0]), np.int64), np.ascontiguousarray(held[1]))

    dealt = rows.select("bucket", "cell", "fp", "near").repartition(partitions(spark), "bucket", "cell").sortWithinPartitions("bucket", "cell")
    return dealt.mapInArrow(run, "a binary, b binary").distinct()


def edges_of(names: list[bytes], pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    ends = [sorted((names[i], names[j])) for i, j in pairs]
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in ends], pa.binary()), pa.array([x[1] for x in ends], pa.binary())], ["a", "b"])


def celled(rows: DataFrame, key: str) -> DataFrame:
    """rows (key, fp, ...) with cell: keys of more than CHUNK rows are dealt out as all pairs of chunks of so many, others have one cell."""
    hot = materialize(rows.groupBy(key).count().filter(F.col("count") > CHUNK).select(key, F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks")), "hot-keys")
    size = hot.count()
    if not size:
        return rows.withColumn("cell", F.lit(0))
    rows = rows.join(F.broadcast(hot) if size <= 10_000 else hot, key, "left")
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.least(mine, j) * 1048576 + F.greatest(mine, j))
    return rows.withColumn("cell", F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(pairs))).drop("chunks")


def alike(fps: np.ndarray, sets: list[np.ndarray], max_bits: int, similarity: float) -> list[tuple[int, int]]:
    """Pairs of texts, of shingle sets at least so similar, that join the parts that all such pairs join.

    Pairs are tried from the nearest fingerprints on, and only between parts that aren't joined yet; where very
    many are left to try, one matrix product gives all their common shingles.
    """
    n = len(sets)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for at in range(0, n, 256):
        bits = np.bitwise_count(fps[at : at + 256, None, :] ^ fps[None, :, :]).sum(axis=2, dtype=np.int32)
        i, j = np.nonzero(bits <= max_bits)
        keep = i + at < j
        found.append((i[keep] + at, j[keep], bits[i[keep], j[keep]]))
    i, j, bits = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(bits, kind="stable")
    i, j = i[order], j[order]
    sizes = np.array([len(s) for s in sets])
    letters = np.unique(np.concatenate(sets)) if len(i) > DENSE else np.empty(0, np.uint64)
    if 0 < n * len(letters) <= MATRIX:
        table = np.zeros((n, len(letters)), np.float32)
        for k, s in enumerate(sets):
            table[k, np.searchsorted(letters, s)] = 1
        common = (table @ table.T)[i, j].astype(np.int64)
        good = common >= similarity * (sizes[i] + sizes[j] - common)
        i, j, known = i[good], j[good], True
    else:
        known = False
    parent = list(range(n))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    out = []
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        x, y = root(a), root(b)
        if x != y:
            if not known:
                common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if common < similarity * (sizes[a] + sizes[b] - common):
                    continue
            parent[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def similar(docs: DataFrame, classes: DataFrame, found: DataFrame, words: int, width: int, max_bits: int, similarity: float, id_col: str, text_col: str) -> DataFrame:
    """a, b: links among the classes of each component found, of texts whose shingle sets are that similar."""
    spark = docs.sparkSession
    groups = found.select("node", "root").unionByName(found.select(F.col("root").alias("node"), "root").distinct())
    members = classes.filter(F.col("first").isNotNull()).join(groups, classes.fp == groups.node).select("root", "fp", F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([np.unique(shingles(t, words)).tobytes() for t in batch.column(2).to_pylist()], pa.binary())], ["root", "fp", "shingles"])

    rows = texts.join(members, ["doc_id", "text_hash"]).select("root", "fp", "text").mapInArrow(sets, "root binary, fp binary, shingles binary").dropDuplicates(["fp"])
    cells = celled(materialize(rows, "shingles"), "root").select(F.xxhash64("root", "cell").alias("key"), "fp", "shingles")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(slices(batches), 0):
            if group.num_rows > 1:
                names = group.column(1).to_pylist()
                fps = np.frombuffer(b"".join(names), ">u8").astype(np.uint64).reshape(len(names), -1)[:, :width]
                each = [np.frombuffer(x, np.uint64) for x in group.column(2).to_pylist()]
                yield edges_of(names, alike(fps, each, max_bits, similarity))

    return cells.repartition(partitions(spark), "key").sortWithinPartitions("key").mapInArrow(meet, "a binary, b binary")


def components(edges: DataFrame, name: str = "stars") -> DataFrame:
    """node, root (the component's smallest node) for each node with a link, by large and small stars."""
    spark = edges.sparkSession
    pairs = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), name)
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e")).select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u <> v").distinct()
        pairs = materialize(small, name)
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
        release(spark)


def simhash_components(docs: DataFrame, words: int = 5, width: int = 1, max_bits: int = 4, similarity: float = 0.8, verify: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, fp, component_id, component_hash for every document: the smallest doc_id that links reach
    from it, and the text (of rows that share that id, the one with the smallest hash) that stands for the group."""
    prints = materialize(fingerprints(docs, words, width, id_col, text_col, verify), "fingerprints")
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash")))
    classes = materialize(prints.groupBy("fp").agg(first.alias("first")), "classes")
    found = components(links(classes, width, max_bits, similarity))
    if verify:
        found = components(similar(docs, classes, found, words, width, max_bits, similarity, id_col, text_col))
    rooted = classes.join(found, classes.fp == found.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    # Written first, so that both sides of the join below are plain shuffles, of which a large group's can be split.
    smallest = materialize(rooted.groupBy("root").agg(F.min("first").alias("least")), "smallest")
    named = rooted.join(smallest, "root").select(F.col("fp").alias("class_fp"), F.col("least.doc_id").alias("component_id"), F.col("least.text_hash").alias("component_hash"))
    return prints.join(named, prints.fp == F.col("class_fp"), "left").select("doc_id", "text_hash", F.substring("fp", 1, 8 * width).alias("fp"), "component_id", "component_hash")


#: For shingle similarity 0.8: 256 bits, of which such a pair differs in 39 on average (deviation 6); 56 lets through nearly all, to be verified.
PIPELINE = {"words": 5, "width": 4, "max_bits": 56, "similarity": 0.8, "verify": True}


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but one document of each group of near-duplicates (five-word shingles, similarity 0.8).

    The smallest doc_id stays; of rows that share that id one stays (other texts under the same id, in other
    groups, are documents of their own). Rows with a null id have no name by which to choose among them, so
    they all stay. All columns are kept as they are.
    """
    found = simhash_components(docs, id_col=id_col, text_col=text_col, **PIPELINE)
    drop = found.filter("doc_id <> component_id OR text_hash <> component_hash").select(F.col("doc_id").alias("__sim_id"), F.col("text_hash").alias("__sim_drop")).distinct()
    named = docs.filter(F.col(id_col).isNotNull()).withColumn("__sim_hash", F.xxhash64(text_col))
    kept = named.join(drop, (F.col(id_col) == F.col("__sim_id")) & (F.col("__sim_hash") == F.col("__sim_drop")), "left_anti").dropDuplicates([id_col, "__sim_hash"])
    return kept.select(docs.columns).unionByName(docs.filter(F.col(id_col).isNull()))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4, width=1, max_bits=4)
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
