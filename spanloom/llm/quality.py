"""Operator 10: quality scores from a hashed word n-gram logistic regression trained by FTRL-proximal.

A text becomes tokens (runs of word characters, runs of signs). Its features are hashed n-grams: single
words and word pairs, and single, double and triple word shapes (lower, title, upper, digits, mixed, each
also as "same word as before"; a run of signs is its own shape). A feature's value is its share among the
n-grams of its kind, so a score is a sparse dot product: the bias plus, for each kind, the mean weight of
the text's n-grams.

Training reads about TRAIN_DOCS labelled documents (a parameter; those whose 62-bit hash of doc_id lies below
that share of all, at any number of labels), four times as many rows at most; one task runs follow-the-regularised-leader
over their sparse vectors, in an order fixed by that hash. The model is at most 2**HASH_BITS weights, whatever
the corpus. Scoring reads every whole text, however long, without shuffle.

Defined cases: null or empty text, or text without a token, scores the bias; null labels and null doc_ids
are not learnt from; of several labels of one doc_id the smallest counts; without any label every score is 0.5;
repeated rows are scored each, and learnt from each; other columns are kept by ``keep_good`` and ignored by ``scored``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, drawn, slices, worker_state

HASH_BITS, TRAIN_DOCS, EPOCHS, CACHED = 18, 6000, 3, 400_000
ALPHA, BETA, L1, L2, SCALE = 0.3, 1.0, 0.002, 0.002, 4.0
TOKEN = re.compile(r"\w+|[^\w\s]+")
KINDS = 5


class Features:
    """Hashed n-grams of texts; keeps what it knows of a token."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def token(self, t: str) -> int:
        """56 bits of hash and 8 bits of shape."""
        from xxhash import xxh64_intdigest

        h = xxh64_intdigest(t.encode())
        if t[0] == "_" or t[0].isalnum():
            shape = 3 if t.isdigit() else 0 if t.islower() else 1 if t.istitle() else 2 if t.isupper() else 4
        else:
            shape = 5 + h % 251
        self.known[t] = h >> 8 << 8 | shape
        return self.known[t]

    def of(self, text: str | None) -> list[np.ndarray]:
        """The hashed n-grams of each kind, in their order, repeats included; empty without tokens."""
        tokens = TOKEN.findall(text or "")
        if not tokens:
            return []
        found = list(map(self.known.get, tokens))
        if None in found:
            if len(self.known) > CACHED:
                self.known.clear()
            found = [self.known.get(t) or self.token(t) for t in tokens]
        x = np.fromiter(found, np.uint64, len(found))
        word, shape = x >> np.uint64(8), x & np.uint64(255)
        same = np.zeros(len(x), np.uint64)
        same[1:] = x[1:] == x[:-1]
        shape = (shape << np.uint64(1)) | same
        pair = (shape[:-1] << np.uint64(9)) | shape[1:]
        triple = (pair[:-1] << np.uint64(9)) | shape[2:]
        double = word[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[1:]
        kinds = [word, shape, pair, triple, double]
        return [((k * np.uint64(2) + np.uint64(1) + np.uint64(i * 0xC2B2AE3D27D4EB4F % 2**64)) * np.uint64(0xFF51AFD7ED558CCD) >> np.uint64(64 - HASH_BITS)).astype(np.int64) for i, k in enumerate(kinds)]

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Sparse vector: indices and values."""
        kinds = [k for k in self.of(text) if len(k)]
        if not kinds:
            return np.empty(0, np.int64), np.empty(0)
        at, back = np.unique(np.concatenate(kinds), return_inverse=True)
        return at, np.bincount(back, np.concatenate([np.full(len(k), SCALE / len(k)) for k in kinds]))


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias by FTRL-proximal over (label, indices, values); the bias has the last place."""
    size = 1 << HASH_BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(epochs):
        for label, at, x in rows:
            at, x = np.append(at, size), np.append(x, 1.0)
            w = weights(z[at], n[at])
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    w = weights(z, n)
    return w[:size], float(w[size])


def fitted(docs: DataFrame, labels: DataFrame, learn: Column, train_docs: int = TRAIN_DOCS, label_col: str = "quality") -> tuple[np.ndarray, float]:
    """The model from the labelled documents for which ``learn`` (over doc_id) holds, about train_docs of them at most."""
    bounded_batches(docs.sparkSession)
    usable = labels.select("doc_id", F.col(label_col).cast("int").alias("label")).filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & learn)
    order = F.xxhash64("doc_id", F.lit(10))
    chosen = usable.filter(drawn(order, train_docs, usable.count())).groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(order, "doc_id").limit(2 * train_docs)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(order.alias("at"), "label", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Features()
        for batch in slices(batches):
            both = [of.vector(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([a.astype("<i4").tobytes() for a, _ in both], pa.binary()), pa.array([x.astype("<f4").tobytes() for _, x in both], pa.binary())], ["at", "label", "places", "shares"])

    def learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(y, np.frombuffer(a, "<i4").astype(np.int64), np.frombuffer(x, "<f4").astype(float)) for b in batches for y, a, x in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True)]
        w, bias = train(rows)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array([*at.tolist(), -1], pa.int32()), pa.array([*w[at].tolist(), bias], pa.float64())], ["place", "weight"])

    vectors = texts.mapInArrow(extract, "at long, label int, places binary, shares binary")
    model = vectors.orderBy("at", "label", "places", "shares").limit(4 * train_docs).mapInArrow(learnt, "place int, weight double").toArrow()
    w, bias = np.zeros(1 << HASH_BITS), 0.0
    if model.num_rows:
        at, values = model.column(0).to_numpy(), model.column(1).to_numpy()
        bias = float(values[at < 0].sum())
        w[at[at >= 0]] = values[at >= 0]
    return w, bias


def score_of(of: Features, text: str | None, weights: np.ndarray, bias: float) -> float:
    logit = bias + sum(SCALE * float(weights[k].mean()) for k in of.of(text) if len(k))
    return 1 / (1 + np.exp(-min(35.0, max(-35.0, logit))))


def features() -> Features:
    return worker_state("quality", Features)


def scored(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, (w, bias) = features(), shared.value
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([score_of(of, t, w, bias) for t in batch.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose score reaches the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))

    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, (w, bias) = features(), shared.value
        for batch in slices(batches):
            yield batch.filter(pa.array([score_of(of, t, w, bias) >= threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def remainder(by: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % by


def production_model(spark: SparkSession, sf_dir: str) -> tuple[np.ndarray, float]:
    return fitted(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), remainder(3) != 1)


def op10_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), production_model(spark, sf_dir))
    return done.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
