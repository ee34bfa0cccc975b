import hashlib
import json
import zlib

import numpy as np
import pytest

from spanloom.llm import media
from spanloom.llm.common import scratch

from .cases import ROWS, documents, empty


@pytest.mark.parametrize("text", [t for _, t in ROWS] + ["é" * 33, "x" * 64, "x" * 65])
def test_images_round_trip(text):
    payload, n = media.payload_of(text)
    assert len(payload) % 64 == 0 < len(payload) and payload[:n] == (text or "").encode() and not any(payload[n:])
    assert media.from_png(media.to_png(payload)).tobytes() == payload


def test_damaged_image_is_noticed():
    png = bytearray(media.to_png(b"a" * 64))
    png[50] ^= 1
    with pytest.raises(ValueError):
        media.from_png(bytes(png))


@pytest.mark.parametrize("size", [100, 16 << 20])
def test_rows(spark, size):
    folder = scratch(spark, "test")
    media.write_archives(documents(spark).repartition(3), folder)
    rows = media.media_features(spark.read.format("spanarchive").option("range_bytes", size).load(folder)).collect()
    assert len(rows) == len(ROWS)
    want = []
    for i, t in ROWS:
        raw = (t or "").encode()
        p = raw + bytes(-len(raw) % 64) if raw else bytes(64)
        want.append((str(i), len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), hashlib.sha256(media.to_png(p)).hexdigest()))
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_sha256"]) for r in rows) == sorted(want)
    same = {r["payload_sha256"]: r["feature"] for r in rows}
    assert all(same[r["payload_sha256"]] == r["feature"] for r in rows)


def test_members_are_retried_by_offset(tmp_path):
    from pyarrow import fs

    writer = media.ArchiveWriter(str(tmp_path))
    done = writer.write(iter([media.batch_of([(1, 3, b"one"), (2, 5, b"two22"), (None, 1, b"x")])]))
    writer.commit([done, None])
    local = fs.LocalFileSystem()
    path = f"{tmp_path}/{done.path}"
    entries = media.directory(local, path)

    class Flaky:
        """Opened files whose first reads of a place fail; counts the reads of each place."""

        def __init__(self):
            self.reads = {}

        def open_input_file(self, p):
            outer, f = self, local.open_input_file(p)

            class File:
                __enter__ = lambda s: s
                __exit__ = lambda s, *a: f.close()

                def read_at(self, n, at):
                    outer.reads[at] = outer.reads.get(at, 0) + 1
                    if at == int(entries[1]["offset"]) and outer.reads[at] < 3:
                        raise OSError("lost")
                    return f.read_at(n, at)

            return File()

    flaky = Flaky()
    opened = flaky.open_input_file(path)
    assert [media.member(flaky, path, opened, e) for e in entries] == [b"one", b"two22", b"x"]
    assert [flaky.reads[int(e["offset"])] for e in entries] == [1, 3, 1]


def test_files_of_lost_attempts_are_not_read(tmp_path):
    writer = media.ArchiveWriter(str(tmp_path))
    lost, won = (writer.write(iter([media.batch_of([(1, 1, b"a")])])) for _ in range(2))
    writer.commit([won])
    assert json.loads((tmp_path / "manifest.json").read_text()) == [[won.path, won.size]] and lost.path != won.path
    reader = media.ArchiveReader(str(tmp_path))
    assert [b.num_rows for p in reader.partitions() for b in reader.read(p)] == [1]


def test_empty_table(spark):
    folder = scratch(spark, "test")
    media.write_archives(empty(spark), folder)
    assert media.media_features(spark.read.format("spanarchive").load(folder)).count() == 0


def test_features_depend_on_samples_only():
    a = np.frombuffer(b"ab" * 64, np.uint8).reshape(-1, 64)
    assert media.feature(a) == media.feature(a.copy()) != media.feature(a[:1])
