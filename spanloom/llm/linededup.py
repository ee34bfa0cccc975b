"""Operator 6: line deduplication with two Bloom filters.

1. every task sets the bits of its documents' line hashes in two filters, ``once`` and ``twice`` (bits hit by
   a second document), kept as pieces of PIECE bits;
2. pieces meet by number and merge: twice = twice_a | twice_b | (once_a & once_b), once = once_a | once_b, in
   any order. A line of two documents has all its bits in ``twice``, so none is missed;
3. with ``twice`` (at most MAX_BITS bits, whatever the corpus) broadcast, only lines whose bits are all in it
   are suspects. They shuffle as digests: smallest and largest doc_id of a digest tell whether it is repeated
   and which document comes first. On a corpus too large for the filter more lines are suspects; the result
   stays exact;
4. the documents are written once with their suspects; those without are done, the others meet their list of
   lines to drop, by id and a hash of the text, so that no list is longer than a text, whatever shares an id.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased; keys of min_chars code points
or more count. Defined cases: null or empty text is one empty line; a null doc_id comes after all others;
rows that repeat a doc_id are one document for the choice, and each row keeps or loses its own lines; a line
repeated within one document only stays; a very long text is one row like any other; there are no ties (all
lines but those of the smallest doc_id go); an empty table gives an empty result; ``deduplicated`` keeps all
other columns, whatever their names (names that begin with ``__line_`` are its own).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from .common import bounded_batches, materialize, partitions, slices

#: Bits per line and filter; hash functions; least and most bits of a filter (32 MB); bits of a piece.
BITS_A_LINE, HASHES, MIN_BITS, MAX_BITS, PIECE = 16, 4, 1 << 20, 1 << 28, 1 << 19
NO_ID = (1 << 63) - 1
SPACE = b" \t\n\x0b\x0c\r"


def lines_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split(b"\n")


def keys_of(lines: list[bytes], min_chars: int) -> list[bytes | None]:
    """The key of each line, as UTF-8; None where it is too short to count."""
    keys = [x.strip(SPACE).lower() for x in lines]  # bytes.lower() changes A-Z only
    return [k if len(k) >= 4 * min_chars or len(k) >= min_chars and len(k.decode()) >= min_chars else None for k in keys]


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def positions(keys: list[bytes], bits: int) -> np.ndarray:
    """A row of HASHES bit positions for each key (bits: a power of two)."""
    from xxhash import xxh3_128_digest

    h = np.frombuffer(b"".join(xxh3_128_digest(k) for k in keys), ">u8").astype(np.uint64).reshape(-1, 2)
    return ((h[:, :1] + np.arange(HASHES, dtype=np.uint64) * (h[:, 1:] | np.uint64(1))) & np.uint64(bits - 1)).astype(np.int64)


def filter_bits(lines: int) -> int:
    return min(MAX_BITS, max(MIN_BITS, 1 << (BITS_A_LINE * max(1, lines) - 1).bit_length()))


def packed(piece: np.ndarray) -> bytes:
    return zlib.compress(piece.tobytes(), 1)


def unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob), np.uint8)


def twice_filter(docs: DataFrame, min_chars: int) -> tuple[np.ndarray, int]:
    """The packed bits of ``twice`` over docs (text), and how many bits it has."""
    spark = docs.sparkSession
    n = docs.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    bits = filter_bits(n)
    pieces = bits // min(PIECE, bits)
    size = bits // pieces // 8

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        for batch in slices(batches):
            for text in batch.column(0).to_pylist():
                if keys := list({k for k in keys_of(lines_of(text), min_chars) if k is not None}):
                    at = np.unique(positions(keys, bits))
                    byte, bit = at >> 3, np.left_shift(1, at & 7).astype(np.uint8)
                    np.bitwise_or.at(twice, byte, once[byte] & bit)
                    np.bitwise_or.at(once, byte, bit)
        for p in np.flatnonzero(once.reshape(pieces, -1).any(axis=1)).tolist():
            a, b = (packed(x[p * size : (p + 1) * size]) for x in (once, twice))
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([a], pa.binary()), pa.array([b], pa.binary())], ["piece", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in slices(batches, 64):
            for p, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = unpacked(a), unpacked(b)
                if p in held:
                    once, twice = held[p]
                    held[p] = [once | a, twice | b | (once & a)]
                else:
                    held[p] = [a, b]
        for p, (_, b) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([packed(b)], pa.binary())], ["piece", "twice"])

    merged = docs.select("text").mapInArrow(build, "piece int, once binary, twice binary").repartition(min(partitions(spark), pieces), "piece").mapInArrow(merge, "piece int, twice binary")
    out = np.zeros((pieces, size), np.uint8)
    for r in materialize(merged, "twice").toLocalIterator():
        out[r["piece"]] = unpacked(bytes(r["twice"]))
    return out.reshape(-1), bits


def suspects_of(text: str | None, twice: np.ndarray, bits: int, min_chars: int) -> list[bytes]:
    """Digests of the text's keys that may stand in a second document."""
    keys = list({k for k in keys_of(lines_of(text), min_chars) if k is not None})
    if not keys:
        return []
    at = positions(keys, bits)
    hit = (twice[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(axis=1)
    return sorted({digest(keys[i]) for i in np.flatnonzero(hit).tolist()})


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """docs with the lines that stay as text, and columns with the number of lines before and of those dropped.

    Columns of docs that have the names in ``counts`` are replaced.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.drop(*counts)
    found, bits = twice_filter(docs.select(F.col(text_col).alias("text")), min_chars)
    shared = spark.sparkContext.broadcast(found)
    at = docs.columns.index(text_col)
    done = StructType([*docs.schema.fields, StructField(counts[0], LongType()), StructField(counts[1], LongType())])
    told = StructType([*docs.schema.fields, StructField("__line_suspects", ArrayType(BinaryType()))])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            each = [suspects_of(t, shared.value, bits, min_chars) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(each, pa.list_(pa.binary()))], told.names)

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, total, gone = [], [], []
            for t, drops in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                lines, drops = lines_of(t), set(drops or ())
                stay = [x for x, k in zip(lines, keys_of(lines, min_chars), strict=True) if k is None or digest(k) not in drops] if drops else lines
                texts.append(None if t is None else b"\n".join(stay))
                total.append(len(lines))
                gone.append(len(lines) - len(stay))
            columns = batch.columns[:-1]
            columns[at] = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(gone, pa.int64())], done.names)

    each = [F.col(f"`{c}`") for c in docs.columns]
    name = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("__line_doc")
    marked = materialize(docs.mapInArrow(mark, told).withColumns({"__line_doc": name, "__line_hash": F.xxhash64(f"`{text_col}`")}), "marked")
    some = F.size("__line_suspects") > 0
    suspects = marked.filter(some).select("__line_doc", "__line_hash", F.explode("__line_suspects").alias("__line_digest"))
    repeated = materialize(suspects.groupBy("__line_digest").agg(F.min("__line_doc").alias("first"), F.max("__line_doc").alias("last")).filter("first < last").select("__line_digest", "first"), "repeated")
    drops = suspects.join(repeated, "__line_digest").filter(F.col("__line_doc") > F.col("first")).groupBy("__line_doc", "__line_hash").agg(F.collect_set("__line_digest").alias("__line_drops"))
    met = marked.filter(some).join(drops, ["__line_doc", "__line_hash"], "left").select(*each, "__line_drops")
    lines = F.length(f"`{text_col}`") - F.length(F.replace(f"`{text_col}`", F.lit("\n"), F.lit(""))) + 1
    clean = marked.filter(~some).select(*each, F.coalesce(lines, F.lit(1)).cast("long").alias(counts[0]), F.lit(0).cast("long").alias(counts[1]))
    return clean.unionByName(met.mapInArrow(drop, done))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the lines that stay as text, and the columns that docs has."""
    return line_dedup(docs, id_col, text_col, counts=("__line_total", "__line_gone")).select([F.col(f"`{c}`") for c in docs.columns])


def op6_bloom_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = """
WITH split AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, r, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM split),
keyed AS (SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
firsts AS (SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) > 1),
told AS (SELECT keyed.*, first IS NOT NULL AND doc_id > first AS gone FROM keyed LEFT JOIN firsts USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM told GROUP BY doc_id, r
"""
