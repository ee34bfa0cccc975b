"""Operator 4: stupid-backoff scores of all documents under the n-gram counts of all other documents.

Words are hashed to 64 bits and documents gathered into blocks of about BLOCK_WORDS words, or BLOCK_DOCS documents, a
table bucketed by block, a bucket for every BUCKET_CHARS of text. For each order the blocks' distinct n-grams, with how
often the block has them, go to the bucket of their leading hash bits; a bucket is one part of that order's count table:
it adds up the counts, joins them to the n-grams that asked, and sends them back to the blocks. Both ways they travel
packed as columns of integers, a row a (bucket, block): as rows of their own they would need more disk than the text
does five times over. From the third order on an n-gram is sent only if both its (n-1)-grams occur in other documents,
as it can't otherwise. Last, blocks meet their counts and add the scores up per document.

Every n-gram of a document occurs in the corpus, in that very document. With ``leave_out`` a document's own n-grams are
no evidence for it: c counts the other documents' only. Without, c counts all.
S(w | u v) = c(u v w) / c(u v) if c(u v w) > 0, else alpha * S(w | v); S(w) = max(1, c(w)) / N. A word near
the beginning of its document begins with the history that it has. One n-gram is one row a block whatever its
frequency, so a very common word is no hot key; a bucket holds about BUCKET_WORDS words' n-grams, and tasks grow in
number, not in size.

Words are ``[^\\x20\\x09-\\x0D]+``. Defined cases: null or empty text has no words and score 0; null doc_id stays
null; repeated rows are documents of their own; a very long text is a block of its own; no ties arise; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, discard, materialize, release, removed, scratch, slices, worker_state

ORDER, ALPHA = 3, 0.4
BLOCK_WORDS, BLOCK_DOCS, BUCKET_WORDS, BUCKET_CHARS, CACHED = 1 << 20, 1 << 17, 1 << 21, 8_000_000, 400_000
BLOCK = "block long, doc_ids array<long>, lengths binary, vocabulary binary, places binary, n_words long"
GRAMS = "gram_order int, bucket int, block long, grams binary, times binary"
COUNTS = "gram_order int, bucket int, block long, counts binary"


def pack(a: np.ndarray) -> bytes:
    """Unsigned integers in as many byte planes as the largest needs."""
    width = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(a, "<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8, offset=1).reshape(blob[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view("<u8").reshape(-1)


def steps(a: np.ndarray) -> np.ndarray:
    """Differences of a sorted array, from zero; np.cumsum undoes it."""
    out = a.copy()
    out[1:] -= a[:-1]
    return out


def chained(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of n-grams from those of their first n-1 words and of their last word."""
    x = before * np.uint64(0x9E3779B97F4A7C15) + word
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_hashes(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """64-bit hashes; ``known`` keeps those of words that were met."""
    from xxhash import xxh64_intdigest

    found = list(map(known.get, words))
    if None in found:
        if len(known) > CACHED:
            known.clear()
        for i, h in enumerate(found):
            if h is None:
                found[i] = known[words[i]] = xxh64_intdigest(words[i])
    return np.fromiter(found, np.uint64, len(found))


def blocks(docs: DataFrame, id_col: str, text_col: str, name: str, path: str) -> int:
    """Write the documents' words as a table bucketed by block; how many buckets it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, names, held, size = TaskContext.get().partitionId(), 0, [], [], 0
        known = worker_state("words", dict)

        def block() -> pa.RecordBatch:
            words, at = np.unique(np.concatenate(held), return_inverse=True)
            row = [(part << 32) | seq, names, pack(np.array([len(h) for h in held], np.uint64)), pack(steps(words)), pack(at.astype(np.uint64)), size]
            types = [pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], [x.split()[0] for x in BLOCK.split(", ")])

        for batch in slices(batches):
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names.append(name)
                held.append(word_hashes((text or "").encode().split(), known))
                size += len(held[-1])
                if size >= BLOCK_WORDS or len(names) >= BLOCK_DOCS:
                    yield block()
                    seq, names, held, size = seq + 1, [], [], 0
        if held:
            yield block()

    spark = docs.sparkSession
    bounded_batches(spark)
    buckets = max(1, -(-int(docs.agg(F.sum(F.length(text_col))).first()[0] or 0) // BUCKET_CHARS))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, BLOCK)
    rows.write.option("compression", "zstd").option("path", path).bucketBy(buckets, "block").sortBy("block").saveAsTable(name)
    return buckets


class Words:
    """A block's words: hashes, place in their document, and the n-gram hashes by order."""

    def __init__(self, lengths: bytes, vocabulary: bytes, places: bytes):
        self.lengths = unpack(lengths).astype(np.int64)
        self.first = np.cumsum(unpack(vocabulary))[unpack(places)] if self.lengths.sum() else np.empty(0, np.uint64)
        ends = np.cumsum(self.lengths)
        self.place = np.arange(len(self.first)) - np.repeat(ends - self.lengths, self.lengths)
        self.grams = [self.first]

    def order(self, n: int) -> np.ndarray:
        """The hash of the n-gram that ends at each word (of use where the word's place is n - 1 or more)."""
        while len(self.grams) < n:
            last = self.grams[-1]
            self.grams.append(np.concatenate([self.first[:1], chained(last[:-1], self.first[1:])]))
        return self.grams[n - 1]

    def own(self, n: int) -> np.ndarray:
        """How often its document has the n-gram that ends at each word."""
        inside, out = self.place >= n - 1, np.zeros(len(self.first), np.int64)
        of = np.repeat(np.arange(len(self.lengths), dtype=np.uint64), self.lengths)
        _, at, times = np.unique(chained(self.order(n)[inside], of[inside]), return_inverse=True, return_counts=True)
        out[inside] = times[at]
        return out

    def asked(self, n: int, below: np.ndarray | None) -> np.ndarray:
        """Which words' n-grams need their count, from the counts of the order below (none for orders 1 and 2)."""
        ask = self.place >= n - 1
        if below is not None:
            ask[1:] &= (below[1:] > 0) & (below[:-1] > 0)
        return ask


def rows_of(block: int, words: Words, n: int, ask: np.ndarray, bits: int) -> Iterator[tuple]:
    grams, times = np.unique(words.order(n)[ask], return_counts=True)
    bucket = (grams >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(grams), np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(grams)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            low = np.uint64(int(bucket[a]) << (64 - bits)) if bits else np.uint64(0)
            yield n, int(bucket[a]), block, pack(steps(grams[a:b] - low)), pack(times[a:b].astype(np.uint64))


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [f for f, _ in fields])


def known(words: Words, n: int, ask: np.ndarray, told: list[dict]) -> np.ndarray:
    """The count of the n-gram at each word, 0 where it wasn't asked."""
    out = np.zeros(len(words.first), np.int64)
    if ask.any():
        _, at = np.unique(words.order(n)[ask], return_inverse=True)
        parts = [unpack(t["counts"]) for t in sorted((t for t in told if t["gram_order"] == n), key=lambda t: t["bucket"])]
        out[ask] = np.concatenate(parts).astype(np.int64)[at]
    return out


def counted(words: Words, order: int, told: list[dict], leave_out: bool) -> list[np.ndarray]:
    """The counts of orders 1 to order at each word."""
    out: list[np.ndarray] = []
    for n in range(1, order + 1):
        ask = words.asked(n, out[-1] if n > 2 else None)
        count = known(words, n, ask, told)
        out.append(np.where(ask, count - words.own(n), 0) if leave_out and ask.any() else count)
    return out


def add_up(grams: DataFrame, parts: int) -> DataFrame:
    """The counts over all blocks of the n-grams that blocks ask for, in so many tasks."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        parts = [np.cumsum(unpack(r["grams"])) for r in rows]
        _, at = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(at, np.concatenate([unpack(r["times"]) for r in rows])).astype(np.uint64)[at]
        cuts = np.cumsum([len(p) for p in parts])[:-1]
        return pa.Table.from_batches([batch_of([(r["gram_order"], r["bucket"], r["block"], pack(c)) for r, c in zip(rows, np.split(total, cuts), strict=True)], COUNTS)])

    return grams.repartition(parts, "gram_order", "bucket").groupBy("gram_order", "bucket").applyInArrow(run, COUNTS)


def backoff_scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, leave_out: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_backoff (words scored below the longest history they have), score (sum of log S) of every whole text."""
    spark = docs.sparkSession
    name = f"lm_blocks_{uuid.uuid4().hex}"
    path = scratch(spark, name)
    buckets = blocks(docs, id_col, text_col, name, path)
    table = spark.table(name)
    total = table.agg(F.sum("n_words")).first()[0] or 0
    bits = max(0, (-(-total // BUCKET_WORDS) - 1)).bit_length()

    def lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            r = batch.to_pylist()[0]
            words = Words(r["lengths"], r["vocabulary"], r["places"])
            for n in range(1, min(order, 2) + 1):
                yield batch_of(list(rows_of(r["block"], words, n, words.asked(n, None), bits)), GRAMS)

    def higher(n: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 1):
                r = batch.to_pylist()[0]
                words = Words(r["lengths"], r["vocabulary"], r["places"])
                below = counted(words, n - 1, r["told"] or [], leave_out)[-1]
                yield batch_of(list(rows_of(r["block"], words, n, words.asked(n, below), bits)), GRAMS)

        return run

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            r = batch.to_pylist()[0]
            words = Words(r["lengths"], r["vocabulary"], r["places"])
            counts = counted(words, order, r["told"] or [], leave_out)
            log = np.log(np.maximum(counts[0], 1) / max(1, total)) if len(counts[0]) else np.empty(0)
            used = np.ones(len(log), np.int64)
            for n in range(2, order + 1):
                at = np.flatnonzero(counts[n - 1] > 0)
                log[at] = np.log(counts[n - 1][at] / counts[n - 2][at - 1])
                used[at] = n
            short = np.minimum(words.place + 1, order) - used
            log += short * np.log(alpha)
            ends = np.cumsum(words.lengths)
            sums = [np.concatenate([[0], np.cumsum(x)]) for x in (log, short > 0)]
            of = np.repeat(np.arange(len(ends)), words.lengths)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("doc_ids"))[0].values.cast(pa.int64()), pa.array(words.lengths), pa.array((sums[1][ends] - sums[1][ends - words.lengths]).astype(np.int64)), pa.array(np.bincount(of, log, minlength=len(ends)).astype(float))],
                ["doc_id", "n_words", "n_backoff", "score"],
            )

    def with_counts(told: DataFrame) -> DataFrame:
        lists = told.repartition(buckets, "block").groupBy("block").agg(F.collect_list(F.struct("gram_order", "bucket", "counts")).alias("told"))
        return table.join(lists, "block", "left")

    parts = 1 << bits
    tables = [materialize(add_up(table.mapInArrow(lower, GRAMS), min(order, 2) * parts), "lm-counts")]
    release(spark)
    for n in range(3, order + 1):
        told = reduce(DataFrame.unionByName, tables)
        tables.append(materialize(add_up(with_counts(told).mapInArrow(higher(n), GRAMS), parts), "lm-counts"))
        release(spark)
    told = reduce(DataFrame.unionByName, tables)
    done = materialize(with_counts(told).mapInArrow(score, "doc_id long, n_words long, n_backoff long, score double"), "lm-scores")
    spark.sql(f"DROP TABLE {name}")
    removed(spark, path)
    discard(*tables)
    return done


def op4_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = backoff_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_words", "n_backoff", F.round("score", 3).alias("score"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
t AS (SELECT r, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d),
g AS (SELECT r, i, w, lag(w) OVER o AS v, lag(w, 2) OVER o AS u FROM t WINDOW o AS (PARTITION BY r ORDER BY i)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY r, w) AS n1,
             CASE WHEN i >= 2 THEN count(*) OVER (PARTITION BY v, w) - count(*) OVER (PARTITION BY r, v, w) ELSE 0 END AS n2,
             CASE WHEN i >= 3 THEN count(*) OVER (PARTITION BY u, v, w) - count(*) OVER (PARTITION BY r, u, v, w) ELSE 0 END AS n3 FROM g),
h AS (SELECT *, lag(n1) OVER o AS h1, lag(n2) OVER o AS h2 FROM c WINDOW o AS (PARTITION BY r ORDER BY i)),
s AS (SELECT r, least(i, 3) AS most, CASE WHEN n3 > 0 THEN 3 WHEN n2 > 0 THEN 2 ELSE 1 END AS used,
             CASE WHEN n3 > 0 THEN ln(n3 / h2) WHEN n2 > 0 THEN ln(n2 / h1) ELSE ln(greatest(1, n1) / (SELECT count(*) FROM t)) END AS l FROM h),
a AS (SELECT r, count(*) AS n_words, count(*) FILTER (used < most) AS n_backoff, sum(l + (most - used) * ln(0.4)) AS score FROM s GROUP BY r)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_backoff, 0) AS n_backoff, round(coalesce(score, 0.0), 3) AS score FROM d LEFT JOIN a USING (r)
"""
