"""Operator 9: media columns through a custom Spark data source over archive directories.

An archive file holds members (PNG images) one after another, then a directory (a row of doc_id, has_id,
offset, length, CRC-32, unpadded bytes for each member) and a footer that says where it begins. ``write``
tasks put one archive each into the folder under a name of their own attempt; the commit lists the winners
in a manifest, so files of lost or repeated attempts are never read. ``read`` plans byte-range partitions
from the archives' sizes alone; a task reads the directory of its archive, takes the members that begin in
its range, and streams their payloads as Arrow batches. A member that fails (I/O, length, checksum) is read
again by its offset alone, up to RETRIES times, without touching the others.

A payload of text is its UTF-8 padded with zero bytes to a positive multiple of 64; its image is 64 pixels
wide, 8 bits of grey each, so the samples are the payload. Folders may be on any store pyarrow.fs knows.

Defined cases: null text is the empty text (a payload of 64 zero bytes); null doc_id stays null; repeated
rows are members of their own; an empty table gives empty archives and an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import bounded_batches, scratch, slices

WIDTH, RETRIES, RANGE_BYTES, BATCH_BYTES = 64, 3, 16 << 20, 8 << 20
ENTRY = np.dtype([("id", "<i8"), ("has_id", "u1"), ("offset", "<u8"), ("length", "<u8"), ("crc", "<u4"), ("n_bytes", "<u8")])
FOOTER = struct.Struct("<QQ8s")
MAGIC = b"SPANARC1"
PNG = b"\x89PNG\r\n\x1a\n"
SCHEMA = "doc_id long, n_bytes long, media binary"


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The padded payload, and the bytes before padding."""
    raw = (text or "").encode()
    return raw.ljust(max(1, -(-len(raw) // WIDTH)) * WIDTH, b"\0"), len(raw)


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # every row begins with its filter, 0: none
    lines[:, 1:] = rows
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 1)) + chunk(b"IEND", b"")


def from_png(media: bytes) -> np.ndarray:
    """The samples, a row of pixels each; checks every chunk."""
    if media[:8] != PNG:
        raise ValueError("not a PNG image")
    at, data, head = 8, [], None
    while at < len(media):
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("a chunk's checksum is wrong")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("only 8-bit grey images without interlacing")
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(head[1], head[0] + 1)
    if lines[:, 0].any():
        raise ValueError("only rows without a filter")
    return lines[:, 1:]


def feature(samples: np.ndarray) -> str:
    """Height, mean, deviation and entropy of the samples, and which columns are brighter than the mean."""
    count = np.bincount(samples.ravel(), minlength=256)
    n, v = samples.size, np.arange(256)
    total = int(count @ v)
    mean = total / n
    var = max(0.0, int(count @ (v * v)) / n - mean * mean)
    p = count[count > 0] / n
    bright = np.packbits(samples.sum(axis=0, dtype=np.int64) * WIDTH > total).tobytes().hex()
    return f"h{len(samples)};m{mean:.4f};s{var ** 0.5:.4f};e{float(-(p * np.log2(p)).sum()):.4f};c{bright}"


def store(folder: str):
    """File system and path of a folder's URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class Done(WriterCommitMessage):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, base = store(self.folder)
        fs.create_dir(base, recursive=True)
        name = f"part-{uuid.uuid4().hex}.arc"
        entries, at = [], 0
        with fs.open_output_stream(f"{base}/{name}") as out:
            for batch in slices(iterator, 64):
                for doc_id, n_bytes, media in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    entries.append((doc_id or 0, doc_id is not None, at, len(media), zlib.crc32(media), n_bytes))
                    out.write(media)
                    at += len(media)
            directory = np.array(entries, ENTRY).tobytes()
            out.write(directory)
            out.write(FOOTER.pack(at, len(entries), MAGIC))
        return Done(name, at)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, base = store(self.folder)
        fs.create_dir(base, recursive=True)
        with fs.open_output_stream(f"{base}/manifest.json") as out:
            out.write(json.dumps([[m.path, m.size] for m in messages if isinstance(m, Done)]).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, base = store(self.folder)
        for m in messages:
            if isinstance(m, Done):
                fs.delete_file(f"{base}/{m.path}")


class ArchiveReader(DataSourceReader):
    def __init__(self, folder: str, range_bytes: int = RANGE_BYTES):
        self.folder, self.range_bytes = folder, range_bytes

    def partitions(self) -> list[InputPartition]:
        fs, base = store(self.folder)
        with fs.open_input_stream(f"{base}/manifest.json") as f:
            archives = json.loads(f.read())
        return [Range(name, a, a + self.range_bytes) for name, size in archives for a in range(0, size, self.range_bytes)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, base = store(self.folder)
        path = f"{base}/{partition.path}"
        entries = retried(lambda: directory(fs, path))
        entries = entries[(entries["offset"] >= partition.start) & (entries["offset"] < partition.end)]
        held: list[tuple[Any, int, bytes]] = []
        size = 0
        with fs.open_input_file(path) as f:
            for e in entries:
                media = member(fs, path, f, e)
                held.append((int(e["id"]) if e["has_id"] else None, int(e["n_bytes"]), media))
                size += len(media)
                if size >= BATCH_BYTES:
                    yield batch_of(held)
                    held, size = [], 0
        if held:
            yield batch_of(held)


def batch_of(rows: list[tuple[Any, int, bytes]]) -> pa.RecordBatch:
    ids, sizes, media = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def retried(read, retries: int = RETRIES, pause: float = 0.1):
    """What read() returns; OSError and ValueError are tried again, so many times."""
    for k in range(retries + 1):
        try:
            return read()
        except (OSError, ValueError):
            if k == retries:
                raise
            time.sleep(pause * 2**k)


def directory(fs, path: str) -> np.ndarray:
    with fs.open_input_file(path) as f:
        size = f.size()
        at, n, magic = FOOTER.unpack(f.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC or at + n * ENTRY.itemsize + FOOTER.size != size:
            raise ValueError(f"{path} is not a whole archive")
        return np.frombuffer(f.read_at(n * ENTRY.itemsize, at), ENTRY)


def member(fs, path: str, opened, entry: np.void) -> bytes:
    """One member by its offset: from the open file, then, if that fails, from the file opened anew."""

    def checked(f) -> bytes:
        media = f.read_at(int(entry["length"]), int(entry["offset"]))
        if len(media) != entry["length"] or zlib.crc32(media) != entry["crc"]:
            raise ValueError(f"{path}: the member at {entry['offset']} is damaged")
        return media

    def again() -> bytes:
        with fs.open_input_file(path) as f:
            return checked(f)

    try:
        return checked(opened)
    except (OSError, ValueError):
        return retried(again)


class ArchiveSource(DataSource):
    """``spark.read.format("spanarchive").load(folder)``; option range_bytes."""

    @classmethod
    def name(cls) -> str:
        return "spanarchive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return ArchiveReader(self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return ArchiveWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArchiveSource)


def write_archives(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Store the whole texts of docs as images in archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            both = [payload_of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for _, n in both], pa.int64()), pa.array([to_png(p) for p, _ in both], pa.binary())], ["doc_id", "n_bytes", "media"])

    register(docs.sparkSession)
    bounded_batches(docs.sparkSession)
    docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA).write.format("spanarchive").mode("append").save(folder)


def media_features(archives: DataFrame) -> DataFrame:
    """Sizes, checksums and features of stored images, from the bytes read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            rows = []
            for media in batch.column(2).to_pylist():
                samples = from_png(media)
                payload = samples.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], NAMES)

    return archives.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def op9_media_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "archives")
    write_archives(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return media_features(spark.read.format("spanarchive").load(folder))
