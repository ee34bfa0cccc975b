"""Operator 1: token-ID output coded by a static range asymmetric numeral system (rANS).

A token file is a folder of two Parquet tables, so it lives on any store that Spark reaches and Spark's
commit protocol keeps the tasks' output whole when executors are lost:

* ``table``: id, freq. One frequency table that all blocks share; frequencies add up to 2**BITS.
* ``blocks``: part, seq, rel_start, n_tokens, doc_ids, block. Blocks hold whole documents in ascending
  doc_id order (null first) and decode independently of each other.

A block's bytes: a header (magic, lanes, stride, counts), the lengths of its documents, then for every
``stride`` steps a checkpoint (position in the words, CRC-32 of the ids up to the next checkpoint, the
states of all lanes), then the 32-bit words, and last the CRC-32 of everything before. Lane j of step t
codes id t * lanes + j. States are 64 bits wide with 32-bit renormalisation. Decoding can begin at any
checkpoint, so the segments of a block, like the blocks, can be decoded in parallel.

Defined cases: null text is an empty document (only the end id); null doc_id sorts first; repeated rows
are separate documents; ties in doc_id are ordered by their ids; an empty table gives a file without
blocks; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, codec, materialize, partitions, release, scratch, slices

BITS, LANES, STRIDE, BLOCK_TOKENS = 20, 2048, 128, 1 << 20
LOW = np.uint64(1 << 31)
HEAD = struct.Struct("<4sHHIII")


def quantized(counts: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Frequencies that add up to 2**bits and are at least 1 where counts are."""
    total, whole = int(counts.sum()), 1 << bits
    seen = int((counts > 0).sum())
    if seen > whole:
        raise ValueError("more symbols than slots")
    if not total:
        return np.zeros(len(counts), np.int64)
    freq = np.where(counts > 0, 1 + (counts * ((whole - seen) / total)).astype(np.int64), 0)
    while (rest := whole - int(freq.sum())) != 0:
        order = np.argsort(-freq, kind="stable")[: abs(rest)]
        freq[order] += 1 if rest > 0 else -(freq[order] > 1)
    return freq


class Coder:
    """Encodes and decodes blocks under one frequency table."""

    def __init__(self, freq: np.ndarray, lanes: int = LANES, stride: int = STRIDE, bits: int = BITS):
        self.lanes, self.stride, self.bits = lanes, stride, np.uint64(bits)
        self.freq = freq.astype(np.uint64)
        self.low = (np.cumsum(freq) - freq).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)

    def encode(self, ids: np.ndarray, lengths: np.ndarray) -> bytes:
        n, w = len(ids), self.lanes
        if n and not self.freq[ids].all():
            raise ValueError("an id is not in the frequency table")
        steps = -(-n // w)
        state = np.full(w, LOW, np.uint64)
        shift, bits, half, low32 = np.uint64(63) - self.bits, self.bits, np.uint64(32), np.uint64(0xFFFFFFFF)
        words, marks = [], {}
        for t in range(steps - 1, -1, -1):
            s = ids[t * w : (t + 1) * w]
            x, f = state[: len(s)], self.freq[s]
            over = x >= (f << shift)
            words.append((x[over] & low32).astype("<u4"))
            x = np.where(over, x >> half, x)
            q = x // f
            state[: len(s)] = (q << bits) + (x - q * f) + self.low[s]
            if t % self.stride == 0:
                marks[t] = state.copy()
        words.reverse()
        at = np.concatenate([[0], np.cumsum([len(x) for x in words], dtype=np.int64)])
        out = [HEAD.pack(b"RANS", w, self.stride, n, len(lengths), int(at[-1])), lengths.astype("<u4").tobytes()]
        for t in sorted(marks):
            segment = ids[t * w : (t + self.stride) * w].astype("<u4").tobytes()
            out += [struct.pack("<II", at[t], zlib.crc32(segment)), marks[t].astype("<u8").tobytes()]
        out += [x.tobytes() for x in words]
        body = b"".join(out)
        return body + struct.pack("<I", zlib.crc32(body))

    def opened(self, block: bytes) -> tuple[int, np.ndarray, list[tuple[int, int, np.ndarray]], np.ndarray]:
        """Number of ids, the documents' lengths, the checkpoints (position, checksum, states), the words."""
        body, (said,) = memoryview(block)[:-4], struct.unpack("<I", block[-4:])
        if zlib.crc32(body) != said:
            raise ValueError("the block's checksum is wrong")
        magic, lanes, stride, n, docs, n_words = HEAD.unpack_from(body)
        if magic != b"RANS" or (lanes, stride) != (self.lanes, self.stride):
            raise ValueError("not a block of this coder")
        at = HEAD.size
        lengths = np.frombuffer(body, "<u4", docs, at)
        at += 4 * docs
        marks = []
        for _ in range(-(-n // (lanes * stride))):
            marks.append((*struct.unpack_from("<II", body, at), np.frombuffer(body, "<u8", lanes, at + 8)))
            at += 8 + 8 * lanes
        return n, lengths, marks, np.frombuffer(body, "<u4", n_words, at)

    def segment(self, n: int, k: int, mark: tuple[int, int, np.ndarray], words: np.ndarray) -> np.ndarray:
        """The ids between checkpoint k and the next, from that checkpoint alone."""
        w, first = self.lanes, k * self.stride * self.lanes
        last = min(n, first + self.stride * w)
        out = np.empty(last - first, np.uint32)
        pos, said, state = mark[0], mark[1], mark[2].copy()
        mask, half = np.uint64((1 << int(self.bits)) - 1), np.uint64(32)
        for at in range(0, last - first, w):
            x = state[: min(w, last - first - at)]
            slot = x & mask
            s = self.symbol[slot]
            out[at : at + len(x)] = s
            x = self.freq[s] * (x >> self.bits) + slot - self.low[s]
            need = np.flatnonzero(x < LOW)
            x[need] = (x[need] << half) | words[pos : pos + len(need)]
            pos += len(need)
            state[: len(x)] = x
        if zlib.crc32(out.astype("<u4").tobytes()) != said:
            raise ValueError("a segment's checksum is wrong")
        return out

    def decode(self, block: bytes) -> tuple[np.ndarray, np.ndarray]:
        n, lengths, marks, words = self.opened(block)
        parts = [self.segment(n, k, m, words) for k, m in enumerate(marks)]
        return (np.concatenate(parts) if parts else np.empty(0, np.uint32)), lengths


def tokenized(docs: DataFrame, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 16-bit) of every whole text, each with end_id appended."""
    bounded_batches(docs.sparkSession)
    end = end_id.to_bytes(2, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = codec(vocabulary)
        for batch in slices(batches):
            ids = [of.encode(t) + end for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def frequencies(tokens: DataFrame) -> np.ndarray:
    """Quantised frequencies of all ids. At most 65,536 rows come to the driver, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(65536, np.int64)
        for batch in slices(batches):
            if data := b"".join(x for x in batch.column(0).to_pylist() if x):
                count += np.bincount(np.frombuffer(data, "<u2"), minlength=65536)
        seen = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(count[seen], pa.int64())], ["id", "n"])

    rows = tokens.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(65536, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return quantized(counts)


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode whole texts and write them to path as a token file, in ascending doc_id order."""
    spark = docs.sparkSession
    tokens = materialize(tokenized(docs, vocabulary, end_id, id_col, text_col), "tokens")
    freq = frequencies(tokens)
    seen = np.flatnonzero(freq)
    spark.createDataFrame(pa.table({"id": pa.array(seen, pa.int32()), "freq": pa.array(freq[seen], pa.int64())})).coalesce(1).write.parquet(f"{path}/table")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, part = Coder(freq), TaskContext.get().partitionId()
        seq, start, held, names, size = 0, 0, [], [], 0

        def block() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u2")
            blob = coder.encode(ids, np.array([len(x) // 2 for x in held], np.uint32))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([start], pa.int64()), pa.array([size], pa.int64()), pa.array([names], pa.list_(pa.int64())), pa.array([blob], pa.binary())], ["part", "seq", "rel_start", "n_tokens", "doc_ids", "block"])

        for batch in slices(batches):
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.append(ids)
                names.append(name)
                size += len(ids) // 2
                if size >= BLOCK_TOKENS:
                    yield block()
                    seq, start, held, names, size = seq + 1, start + size, [], [], 0
        if held:
            yield block()

    ordered = tokens.select("doc_id", "ids").repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(run, "part int, seq int, rel_start long, n_tokens long, doc_ids array<long>, block binary").write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    release(spark)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian 32-bit) of each document of a token file; blocks decode in parallel.

    Only one number per written part comes to the driver: how many ids the parts before it hold.
    """
    freq = np.zeros(65536, np.int64)
    for r in spark.read.schema("id int, freq long").parquet(f"{path}/table").collect():
        freq[r["id"]] = r["freq"]
    blocks = spark.read.schema("part int, seq int, rel_start long, n_tokens long, doc_ids array<long>, block binary").parquet(f"{path}/blocks")
    base, total = {}, 0
    for r in sorted(blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()):
        base[r["part"]], total = total, total + r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq)
        for batch in slices(batches, 1):
            ids, lengths = coder.decode(batch.column(3)[0].as_py())
            data, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(lengths, dtype=np.int64)
            first = base[batch.column(0)[0].as_py()] + batch.column(1)[0].as_py()
            starts = ends - lengths
            yield pa.RecordBatch.from_arrays(
                [batch.column(2)[0].values.cast(pa.int64()), pa.array(first + starts), pa.array(lengths.astype(np.int64)), pa.array([bytes(data[4 * a : 4 * b]) for a, b in zip(starts, ends, strict=True)], pa.binary())],
                ["doc_id", "start", "n_tokens", "ids"],
            )

    return blocks.select("part", "rel_start", "doc_ids", "block").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op1_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch(spark, "token-file")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
