"""What the operators share: scratch tables in the cluster's folder, batch slicing, the word-cached tokenizer."""

from __future__ import annotations

import codecs
import gc
import os
import re
import string
import tempfile
import uuid
from array import array
from collections.abc import Callable, Iterator
from itertools import islice
from typing import Any, TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")

#: Longest chunk that the tokenizer's cache keeps, and entries after which it keeps only the first quarter, where the common words are (bounds a worker's memory).
CACHED_CHARS, CACHED_WORDS = 48, 1_000_000
#: Bytes of text that one batch brings to a Python worker.
BATCH_BYTES = 8 << 20


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share. Where that is unset a local session gets a
    temporary folder of its own; on a cluster, whose executors would each write to their own disk, it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spanloom-')}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/spanloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read that: cuts lineage, survives lost executors, computes once."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "1").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store, which only Spark's file systems may reach."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame | None) -> None:
    """Delete what ``materialize`` wrote for tables that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "scratch_path", None):
            removed(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Let both of the driver's collectors find shuffles that nothing refers to any more, so that their files go before the next round."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES in this session: texts may be long, and a task holds a few batches at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def drawn(order: Column, wanted: int, of: int | Column) -> Column:
    """Whether a row is among about ``wanted`` of ``of`` rows: whether 62 bits of its hash lie below that share, however small it is."""
    share = F.least(F.lit(1.0), F.lit(float(wanted)) / F.greatest(F.lit(1), of if isinstance(of, Column) else F.lit(of)))
    return order.bitwiseAND((1 << 62) - 1) <= F.floor(share * float(1 << 62))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that no worker holds Python objects for more than so many documents."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def runs(batches: Iterator[pa.RecordBatch], key: int, most: int | None = None) -> Iterator[pa.Table]:
    """Rows of one key each, from rows sorted by key; of at most ``most`` rows if given."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        keys = held.column(key).to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield from (held.slice(i, min(most or b, b - i)) for i in range(a, b, most or b))
        held = held.slice(cuts[-1])
        while most and held.num_rows >= 2 * most:
            yield held.slice(0, most)
            held = held.slice(most)
    if held is not None and held.num_rows:
        yield from (held.slice(i, most or held.num_rows) for i in range(0, held.num_rows, most or held.num_rows))


#: A Latin word and the punctuation after it, which this vocabulary's splitter tells apart.
PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-/:-@\[-`{-~]*)")


def latin(text: str) -> bool:
    """Whether all characters are below U+0100: none combines with another, and lower case is a matter of each by itself."""
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


class WordCodec:
    """Token ids of whole texts as little-endian unsigned 16-bit integers.

    word_bpe_49k never merges across white space, so the ids of a text are those of its chunks between
    blanks and line ends, one after another; each worker encodes a chunk once and keeps it. A chunk that is
    a Latin word with punctuation after it goes to the library's model in these two parts, lower-cased, which
    spares normaliser and splitter; any other goes through the whole tokenizer. Texts of Latin-1 characters are
    lower-cased first, as the normaliser does, so that a word is kept once however it is written. A special
    token's string gives that token's id, as the library has it (``literal_specials``: it counts as ordinary
    text); texts that may hold one keep their case. Tests hold this against encoding whole texts.
    """

    def __init__(self, path: str, literal_specials: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal_specials
        if self.tokenizer.get_vocab_size(True) > 65536:
            raise ValueError("ids of this vocabulary need more than 16 bits")
        self.model = self.tokenizer.model
        letters = [chr(i) for i in range(0xDF, 0x100) if i != 0xF7]
        spelt = {i: chr(i) for i in range(128)}  # the character by which the model knows a byte of UTF-8
        for c in letters:
            spelt.update(zip(c.encode(), self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0], strict=True))
        self.spelt = "".join(spelt.get(i, "\ufffe") for i in range(256))  # U+FFFE: a byte that none of these letters has
        self.kept: dict[str, bytes] = {"": b""}

    def word(self, word: str) -> bytes:
        """Ids of lower-case Latin letters, or of punctuation."""
        spelt = word if word.isascii() else codecs.charmap_decode(word.encode(), "strict", self.spelt)[0]
        ids = array("H", [t.id for t in self.model.tokenize(spelt)]).tobytes()
        if len(word) <= CACHED_CHARS:
            self.kept[word] = ids
        return ids

    def chunk(self, chunk: str) -> bytes:
        word = chunk.rstrip(string.punctuation)
        if (word.isascii() and word.isalpha()) or PLAIN.fullmatch(chunk):
            tail, word = chunk[len(word) :], word.lower()
            ids = self.kept.get(word)
            if ids is None:
                ids = self.word(word)
            if word is chunk or word == chunk:
                return ids
            if tail:
                end = self.kept.get(tail)
                ids += self.word(tail) if end is None else end
        else:
            ids = array("H", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        if len(chunk) <= CACHED_CHARS:
            self.kept[chunk] = ids
        return ids

    def spaced(self, text: str) -> str:
        """The text with blanks for line ends and tabs, in lower case where each character's is a matter of its own."""
        if "\n" in text or "\t" in text or "\r" in text:
            text = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
        return text.lower() if "<|" not in text and latin(text) else text

    def encode(self, text: str | None) -> bytes:
        return b"".join(self.looked_up(self.spaced(text).split(" "))) if text else b""

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """What ``encode`` gives for each text. A chunk is looked up once for all of them; the rest is Arrow's."""
        chunks = pc.split_pattern(pa.array([self.spaced(t) if t else "" for t in texts], pa.large_string()), " ")
        each = chunks.flatten().dictionary_encode()
        ids = pa.array(self.looked_up(each.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(each.indices)
        _, offsets, data = ids.buffers()
        if data is None:
            return [b""] * len(texts)
        ends = np.frombuffer(offsets, np.int64)[chunks.offsets.to_numpy()].tolist()
        whole = memoryview(data)
        return [bytes(whole[a:b]) for a, b in zip(ends, ends[1:], strict=False)]

    def looked_up(self, chunks: list[str]) -> list[bytes]:
        found = list(map(self.kept.get, chunks))
        if None in found:
            if len(self.kept) > CACHED_WORDS:
                first = dict(islice(self.kept.items(), CACHED_WORDS // 4))
                self.kept.clear()
                self.kept.update(first)
            i = -1
            for _ in range(found.count(None)):
                i = found.index(None, i + 1)
                found[i] = self.kept.get(chunks[i]) or self.chunk(chunks[i])
        return found


def codec(path: str) -> WordCodec:
    return worker_state(f"codec {path}", lambda: WordCodec(path))


_state: dict[str, Any] = {}


def worker_state(name: str, build: Callable[[], T]) -> T:
    """What an operator keeps in a worker process, which Spark reuses from task to task. A worker holds one operator's at a time."""
    if name not in _state:
        _state.clear()
        gc.collect()
        _state[name] = build()
    return _state[name]
