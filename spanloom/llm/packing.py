"""Operator 7: packing token sequences by lexical retrieval.

Documents are dealt into shards of about SHARD_CHARS characters by content, so that those BM25 ranks high for
each other meet: each is the sum of its terms' BM25 weights times random signs in DIMS dimensions, and goes to the
nearest of two levels of centroids, fitted on a bounded sample. Small clusters that follow each other share a shard;
one of more than two shards' size is split by a hash. Each shard builds a BM25 inverted index of its documents
(terms: token ids; document frequencies and mean length are the corpus's). The first document of a window is its
seed; while the window has room, the unused document that BM25 ranks next for the seed goes in, cut where the
window ends; what is left of a cut document begins, and is the seed of, the next window. So every window but a
shard's last is full. Neighbours in other shards aren't candidates: README gives the measured loss.

Each id of each document lies in exactly one piece. Shards are independent tasks of bounded size, so the
number of documents, a hot source or many copies only make more shards.

``in_order``: the table's order (its files by name and their rows, as a range-sorted table is written) is a
curriculum. It is cut into at most PHASES stretches of equal length, each of which has shards of its own, and
sequences are numbered by stretch: content decides within a stretch only. A table that isn't read from files
has no order and is one stretch.

Defined cases: null or empty text has its end id only; null doc_id stays null; repeated rows are documents
of their own; a document longer than a window, however long, fills several (its shard is then as long as it
is); ties of rank go to the earlier doc_id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_batches, codec, drawn, materialize, partitions, slices, worker_state

WINDOW, SHARD_CHARS = 2048, 2_000_000
K1, B = 1.5, 0.75
#: Dimensions of a document's content vector; sampled documents a cluster and at most; rounds of fitting.
DIMS, PER_CLUSTER, SAMPLE, ROUNDS = 128, 32, 131_072, 8
#: Stretches of an ordered table; entries and documents up to which a shard's scores come from one matrix product, and what an entry of it costs against one of a posting list.
PHASES, MATRIX, TOGETHER, CHEAPER = 16, 16_000_000, 4096, 150
#: Shards that a task packs, one after another, where the session's partitions are fewer: each task writes a file, and starts processes for it.
TASK_SHARDS = 16
RESULT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Corpus(NamedTuple):
    """What BM25 needs to know of the whole corpus."""

    docs: int
    df: np.ndarray
    mean: float

    def weight(self, term: np.ndarray, tf: np.ndarray, size: np.ndarray) -> np.ndarray:
        idf = np.log1p((self.docs - self.df + 0.5) / (self.df + 0.5))
        return idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / self.mean))


class Index:
    """BM25 inverted index over the shard's documents; they are the corpus unless one is given.

    Where posting lists are so full that walking them for every seed costs more than one product of the matrix of
    weights with that of occurrences, the scores of all seeds come from that product.
    """

    def __init__(self, docs: list[np.ndarray], corpus: Corpus | None = None):
        both = [np.unique(d, return_counts=True) for d in docs]
        self.terms = [t for t, _ in both]
        doc = np.repeat(np.arange(len(docs)), [len(t) for t in self.terms])
        term, tf = np.concatenate(self.terms).astype(np.int64), np.concatenate([c for _, c in both]).astype(float)
        df = np.bincount(term, minlength=65536)
        size = np.array([len(d) for d in docs], float)
        weight = (corpus or Corpus(len(docs), df, size.mean())).weight(term, tf, size[doc])
        letters = np.flatnonzero(df)
        n, self.scores = len(docs), None
        seeds = min(n, size.sum() / WINDOW + 1)
        if n <= TOGETHER and n * len(letters) <= MATRIX and n * n * len(letters) < CHEAPER * seeds * (df.astype(float) ** 2).sum() / n:
            table = np.zeros((n, len(letters)), np.float32)
            table[doc, np.searchsorted(letters, term)] = weight
            self.scores = (table > 0).astype(np.float32) @ table.T
        else:
            order = np.argsort(term, kind="stable")
            self.doc, self.weight = doc[order], weight[order]
            self.first = np.concatenate([[0], np.cumsum(df)])

    def scored(self, seed: int) -> np.ndarray:
        """The score of every document for the seed's terms."""
        if self.scores is not None:
            return self.scores[seed]
        t = self.terms[seed].astype(np.int64)
        a, n = self.first[t], self.first[t + 1] - self.first[t]
        at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(self.doc[at], self.weight[at], minlength=len(self.terms))

    def ranked(self, seed: int) -> np.ndarray:
        """All documents, best first; scores that differ by rounding only are ties."""
        return np.argsort(-np.round(self.scored(seed), 3), kind="stable")


def pack(docs: list[np.ndarray], window: int = WINDOW, corpus: Corpus | None = None) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of a shard's documents."""
    index, used, out = Index(docs, corpus), np.zeros(len(docs), bool), []
    nexts = iter(range(len(docs)))
    seq = off = 0
    d, pos, seed, rank = next(nexts), 0, 0, None
    used[d] = True
    while True:
        n = min(window - off, len(docs[d]) - pos)
        out.append((d, pos, n, seq, off))
        pos, off = pos + n, off + n
        if off == window:
            seq, off = seq + 1, 0
        if pos == len(docs[d]):
            if off == 0:
                d = next((i for i in nexts if not used[i]), None)
                seed, rank = d, None
            else:
                rank = iter(index.ranked(seed).tolist()) if rank is None else rank
                d = next((i for i in rank if not used[i]), None)
            if d is None:
                return out
            used[d], pos = True, 0
        elif off == 0:
            seed, rank = d, None


def stretches(docs: DataFrame, phases: int, chars: Column) -> DataFrame:
    """docs with __phase: the stretch, by characters, of the table's order that a row's file begins in; one row a file is numbered."""
    try:
        rows = docs.withColumn("__file", F.col("_metadata.file_name"))
    except AnalysisException:
        return docs.withColumn("__phase", F.lit(0).cast("long"))
    files = materialize(rows.groupBy("__file").agg(F.sum(chars).alias("chars")), "files")
    order, whole = W.orderBy("__file"), W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = F.sum("chars").over(order) - F.col("chars")
    plan = files.select(F.col("__file").alias("__name"), F.floor(before * phases / F.sum("chars").over(whole)).cast("long").alias("__phase"))
    plan = materialize(plan, "stretches")
    return rows.join(F.broadcast(plan) if plan.count() <= 100_000 else plan, F.col("__file") == F.col("__name")).drop("__file", "__name")


def encoded(docs: DataFrame, vocabulary: str, end_id: int, id_col: str, text_col: str, in_order: bool, shard_chars: int) -> DataFrame:
    """phase, salt, chars, doc_id, ids (16-bit) of every whole text with its end id; each task's last row, of phase -1, holds what it counted."""
    bounded_batches(docs.sparkSession)
    end = end_id.to_bytes(2, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from xxhash import xxh64_intdigest

        of, part, row, found = codec(vocabulary), TaskContext.get().partitionId(), 0, np.zeros(65538, np.int64)  # the last two: documents, ids
        for batch in slices(batches, 1024):
            if not batch.num_rows:
                continue
            ids = [x + end for x in of.encode_all(batch.column(3).to_pylist())]
            size, _, term, _ = counted(ids)
            found += np.append(np.bincount(term, minlength=65536), [len(size), size.sum()])
            salt = [xxh64_intdigest(f"{name} {part} {row + i}") >> 1 for i, name in enumerate(batch.column(2).to_pylist())]
            row += len(ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(salt, pa.int64()), batch.column(1), batch.column(2), pa.array(ids, pa.binary())], names)
        if row:
            told = np.stack([np.flatnonzero(found), found[found > 0]]).astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((-1, 0, 0, None, told), (*[pa.int64()] * 4, pa.binary()), strict=True)], names)

    names = ["phase", "salt", "chars", "doc_id", "ids"]
    chars = F.coalesce(F.length(text_col), F.lit(0)).cast("long") + 4
    phase = F.lit(0).cast("long")
    if in_order:
        phases = max(1, min(PHASES, (docs.agg(F.sum(chars)).first()[0] or 0) // shard_chars))
        docs, phase = stretches(docs, phases, chars), F.col("__phase")
    return docs.select(phase.alias("phase"), chars.alias("chars"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "phase long, salt long, chars long, doc_id long, ids binary")


def counted(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the documents; and document, term and frequency of each term of each."""
    size = np.array([len(x) // 2 for x in ids])
    key, tf = np.unique(np.repeat(np.arange(len(ids)) << 16, size) | np.frombuffer(b"".join(ids), "<u2"), return_counts=True)
    return size, key >> 16, key & 0xFFFF, tf


def corpus_of(rows: DataFrame) -> Corpus:
    """Document frequencies over all rows that ``encoded`` gave. At most 65,538 numbers come to the driver, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(65538, np.int64)
        for batch in batches:
            for told in batch.column(0).to_pylist():
                at, n = np.frombuffer(told, "<i8").reshape(2, -1)
                found[at] += n
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(found)), pa.array(found[found > 0])], ["term", "n"])

    found = np.zeros(65538, np.int64)
    for term, n in rows.filter("phase < 0").select("ids").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n")).collect():
        found[term] = n
    return Corpus(int(found[65536]), found[:65536], max(1.0, found[65537] / max(1, found[65536])))


def signs() -> np.ndarray:
    """8 MB, drawn once in each process; the codec and its words, which a worker has kept until then, go."""
    return worker_state("signs", lambda: np.random.default_rng(7).choice(np.array([-1, 1], np.int8), (65536, DIMS)))


def content(ids: list[bytes], corpus: Corpus, sign: np.ndarray) -> np.ndarray:
    """Unit vectors of documents, near where they share terms of much BM25 weight: their weights times the terms' signs."""
    size, doc, term, tf = counted(ids)
    letters = np.flatnonzero(np.bincount(term, minlength=65536))
    table = np.zeros((len(ids), len(letters)), np.float32)
    table[doc, np.searchsorted(letters, term)] = corpus.weight(term, tf, size[doc])
    x = table @ sign[letters].astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def centroids(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means."""
    rng = np.random.default_rng(7)
    middle = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ROUNDS):
        mine = np.concatenate([(x[a : a + 8192] @ middle.T).argmax(axis=1) for a in range(0, len(x), 8192)])
        total = np.zeros_like(middle)
        np.add.at(total, mine, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        middle = np.where(norm > 1e-9, total / np.maximum(norm, 1e-9), middle)
    return middle


class Clusters:
    """Two levels of centroids; about ``leaves`` at the lower one, numbered through."""

    def __init__(self, x: np.ndarray, leaves: int):
        self.top = centroids(x, max(1, round(leaves**0.5)))
        mine = (x @ self.top.T).argmax(axis=1)
        parts = [x[mine == t] for t in range(len(self.top))]
        self.low = [centroids(p, max(1, round(leaves * len(p) / len(x)))) if len(p) else self.top[t : t + 1] for t, p in enumerate(parts)]
        self.first = np.concatenate([[0], np.cumsum([len(m) for m in self.low])])

    def of(self, x: np.ndarray) -> np.ndarray:
        mine, out = (x @ self.top.T).argmax(axis=1), np.empty(len(x), np.int64)
        for t in np.unique(mine):
            out[mine == t] = self.first[t] + (x[mine == t] @ self.low[t].T).argmax(axis=1)
        return out


def shared_out(sizes: np.ndarray, shard_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """First shard, and number of shards, of each (phase, leaf): a phase's leaves that follow each other share one, a leaf of more than two shards' size has several."""
    first, parts, at = np.zeros(sizes.shape, np.int64), np.ones(sizes.shape, np.int64), 0
    for phase, leaves in enumerate(sizes.tolist()):
        held = 0
        for leaf, size in enumerate(leaves):
            if held and held + size > shard_chars:
                at, held = at + 1, 0
            first[phase, leaf] = at
            if size > 2 * shard_chars:
                parts[phase, leaf] = -(-int(size) // shard_chars)
                at, held = at + int(parts[phase, leaf]), 0
            else:
                held += size or 1e-9
        at += held > 0
    return first, parts


def dealt(rows: DataFrame, corpus: Corpus, total: int, shards: int, shard_chars: int) -> DataFrame:
    """shard, doc_id, ids: documents of like content in one shard; a shard's size is that of its leaves' share of the sample."""
    spark = rows.sparkSession

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = signs()
        for batch in slices(batches, 256):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([v.tobytes() for v in content(batch.column(2).to_pylist(), corpus, sign)], pa.binary())], ["phase", "chars", "x"])

    most = min(SAMPLE, max(4096, 2 * shards * PER_CLUSTER))
    some = rows.filter(drawn(F.xxhash64("salt"), most, corpus.docs)).select("phase", "chars", "ids").mapInArrow(vectors, "phase long, chars long, x binary").toArrow()
    x = np.frombuffer(b"".join(some.column(2).to_pylist()), np.float32).reshape(-1, DIMS) if some.num_rows else np.zeros((1, DIMS), np.float32)
    clusters = Clusters(x, min(2 * shards, max(1, len(x) // 8)))
    sizes = np.zeros((PHASES, int(clusters.first[-1])))
    if some.num_rows:
        chars = some.column(1).to_numpy().astype(float)
        np.add.at(sizes, (some.column(0).to_numpy(), clusters.of(x)), chars * total / chars.sum())
    shared = spark.sparkContext.broadcast((clusters, *shared_out(sizes, shard_chars)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign, (to, first, parts) = signs(), shared.value
        for batch in slices(batches, 256):
            if batch.num_rows:
                at = batch.column(0).to_numpy(), to.of(content(batch.column(3).to_pylist(), corpus, sign))
                yield pa.RecordBatch.from_arrays([pa.array(first[at] + batch.column(1).to_numpy() % parts[at]), batch.column(2), batch.column(3)], ["shard", "doc_id", "ids"])

    return rows.select("phase", "salt", "doc_id", "ids").mapInArrow(run, "shard long, doc_id long, ids binary")


def packed(docs: DataFrame, vocabulary: str, end_id: int, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", shard_chars: int = SHARD_CHARS, in_order: bool = False) -> DataFrame:
    """The pieces of all documents: RESULT's columns, sequence_id unique over all shards."""
    spark = docs.sparkSession
    both = materialize(encoded(docs, vocabulary, end_id, id_col, text_col, in_order, shard_chars), "ids")
    rows = both.filter("phase >= 0")
    total = rows.agg(F.sum("chars")).first()[0] or 0
    shards = max(1, -(-total // shard_chars))
    corpus = corpus_of(both) if shards > 1 else None

    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        rows = sorted(zip(table.column("doc_id").to_pylist(), table.column("ids").to_pylist(), strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        texts = [np.frombuffer(r[1], "<u2").astype("<u4") for r in rows]
        found = [(rows[d][0], a, n, zlib.crc32(texts[d][a : a + n].tobytes()), len(texts[d]), (shard << 32) | seq, off) for d, a, n, seq, off in pack(texts, window, corpus)]
        return pa.table([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], [x.split()[0] for x in RESULT.split(", ")])

    placed = dealt(rows, corpus, total, shards, shard_chars) if corpus else rows.select(F.lit(0).cast("long").alias("shard"), "doc_id", "ids")
    placed = placed.repartition(min(shards, max(partitions(spark), shards // TASK_SHARDS)), "shard")
    return placed.groupBy("shard").applyInArrow(run, RESULT)


def op7_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
