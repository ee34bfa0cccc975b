"""Pixels, the image plan, records and the command line."""

import hashlib
import json
import struct
import zlib

import numpy as np
import pytest

from spanloom.__main__ import main
from spanloom.operators import families, imaging
from spanloom.plans import images as plan
from spanloom.sources import config, png
from spanloom.streaming import diagnostics


@pytest.mark.parametrize("depth", [1, 2, 3, 4])
def test_images_round_trip(depth):
    pixels = np.random.default_rng(depth).integers(0, 256, (7, 5, depth)).astype(np.uint8)
    assert (png.decode(png.encode(pixels)) == pixels).all() and png.dimensions(png.encode(pixels)) == (7, 5, depth)


@pytest.mark.parametrize("way", range(5))
def test_filters(way):
    pixels = np.random.default_rng(9).integers(0, 256, (6, 4, 3)).astype(int)
    wide = np.zeros((7, 5, 3), int)
    wide[1:, 1:] = pixels
    left, up, corner = wide[1:, :-1], wide[:-1, 1:], wide[:-1, :-1]
    p = left + up - corner
    near = np.abs(np.stack([p - left, p - up, p - corner])).argmin(axis=0)
    guess = [0, left, up, (left + up) // 2, np.choose(near, [left, up, corner])][way]
    lines = b"".join(bytes([way]) + row.astype(np.uint8).tobytes() for row in (pixels - guess) % 256)
    parts = [(b"IHDR", struct.pack(">IIBBBBB", 4, 6, 8, 2, 0, 0, 0)), (b"IDAT", zlib.compress(lines)), (b"IEND", b"")]
    data = png.SIGNATURE + b"".join(struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b)) for k, b in parts)
    assert (png.decode(data) == pixels).all()


@pytest.mark.parametrize("data", [b"", b"GIF89a", png.SIGNATURE, png.encode(np.zeros((2, 2, 1), np.uint8))[:-20]])
def test_unreadable_images(data):
    with pytest.raises(ValueError):
        png.decode(data)


def test_mask_has_only_what_is_translated_or_removed():
    box = lambda x, y: [[x, y], [x + 40, y], [x + 40, y + 20], [x, y + 20]]
    regions = [{"action": a, "polygon": box(20 + 70 * i, 50)} for i, a in enumerate(("translate", "preserve", "remove", "review"))]
    mask = imaging.text_mask((200, 300), regions, 0)
    assert [mask[60, 40 + 70 * i] for i in range(4)] == [255, 0, 255, 0] and (mask > 0).sum() == 2 * 41 * 21
    assert (imaging.text_mask((200, 300), regions[:1], 3) > 0).sum() == 47 * 27


def test_polygon_fill():
    triangle = imaging.filled((10, 10), [[0, 0], [8, 0], [0, 8]])
    assert triangle[0, :9].all() and triangle[:9, 0].all() and triangle[4, 4] and not triangle[5, 5] and not triangle[9].any()
    assert not imaging.filled((5, 5), []).any()


def test_inpainting_fills_from_the_border():
    pixels = np.full((9, 9, 1), 100, np.uint8)
    mask = np.zeros((9, 9), np.uint8)
    mask[3:6, 3:6] = 255
    pixels[3:6, 3:6] = 0
    assert (imaging.inward(pixels, mask) == 100).all() and (imaging.unchanged(pixels, mask) == pixels).all()


def test_image_plan(spark):
    rng = np.random.default_rng(4)
    shots = [rng.integers(0, 256, (60, 120, 3)).astype(np.uint8) for _ in range(3)]
    box = [[10, 10], [100, 10], [100, 40], [10, 40]]
    key = hashlib.sha256(shots[0].tobytes()).hexdigest()
    known = {key: [("防水面料", 0.9, box), ("USB", 0.9, box), ("低", 0.1, box)]}
    rows = [(f"in/{i}.png", f"in_processed/{i}.png", bytearray(png.encode(s))) for i, s in enumerate(shots[:2])] + [("in/x.png", "in_processed/x.png", bytearray(b"broken"))]
    images = spark.createDataFrame(rows, "path string, target string, content binary")
    prepared = plan.prepared(plan.detected(images, plan.table_recognizer(known), config.Images()), config.Images()).first()
    assert [(r["id"], r["action"], r["text"]) for r in prepared["regions"]] == [("text_000", "translate", "EN:防水面料"), ("text_001", "preserve", None)]
    done = {r["path"]: r for r in plan.processed(images, plan.table_recognizer(known)).collect()}
    assert [done[k]["status"] for k in ("in/0.png", "in/1.png", "in/x.png")] == ["completed", "completed", "failed"]
    assert bytes(done["in/1.png"]["image"]) == png.encode(shots[1])
    assert png.decode(bytes(done["in/0.png"]["image"])).shape == (60, 120, 3) and png.decode(bytes(done["in/0.png"]["mask"]))[20, 20] == 255
    totals = plan.summary(plan.processed(images, plan.table_recognizer(known)), skipped=2).first()
    assert totals.asDict() == {"total": 5, "succeeded": 4, "failed": 1, "skipped": 2, "has_failures": True}


def test_families():
    nllb = families.family(config.Translation())
    assert nllb.source("zh") == "zho_Hans" and nllb.arguments({"eng_Latn": 7}, "en", config.Generation())["forced_bos_token_id"] == 7
    with pytest.raises(config.ConfigError):
        nllb.arguments({}, "en", config.Generation())
    with pytest.raises(config.ConfigError):
        families.family(config.Translation(model_family="helsinki"))
    assert families.family(config.Translation(model_family="helsinki", model_name="opus-mt-zh-en")).source() is None
    assert [families.unknown_tokens([1, 3, 3], 3, p) for p in ("allow", "warn", "reject")] == [(2, None), (2, "warn"), (2, "quality")]


def test_records_are_bounded():
    got = diagnostics.bounded({"a": "é" * 300, "b": list(range(40)), "c": {str(i): i for i in range(40)}, "d": object()})
    assert len(got["a"].encode()) <= 256 and got["a"].endswith("…")
    assert got["b"][-1] == {"__truncated_items__": True} and len(got["b"]) == 33
    assert got["c"]["__truncated_keys__"] is True and got["d"] == {"__unsupported__": "object"}
    deep = value = {}
    for _ in range(20):
        value["x"] = value = {}
    assert "max_depth" in json.dumps(diagnostics.bounded(deep))


def test_records_are_fitted():
    small = {"segments": [{"t": "x" * 100}] * 5}
    assert diagnostics.fitted(small) is small
    cut = diagnostics.fitted({"segments": [{"t": "x" * 3000}] * 200})
    assert len(cut["segments"]) == 16 and cut["segments_truncated"]
    assert diagnostics.fitted({"segments": [{"t": "x" * 100_000}], "segment_count": 1})["segment_count"] == 1


def test_command_line(spark, tmp_path, capsys):
    assert main(["check-cache", str(tmp_path)]) == 1
    spark.createDataFrame([(1, "<p>中</p>")], "doc_id long, html string").write.parquet(f"{tmp_path}/in")
    assert main(["html", f"{tmp_path}/in", f"{tmp_path}/out"]) == 0
    assert spark.read.parquet(f"{tmp_path}/out").first()["html"] == "<p>EN:中</p>"
    (tmp_path / "bad.json").write_text("{")
    assert main(["-c", f"{tmp_path}/bad.json", "check-cache", str(tmp_path)]) == 2


def test_what_a_recognizer_raises_fails_its_image_alone(spark):
    small, large = (png.encode(np.full((8, w, 3), 200, np.uint8)) for w in (8, 16))
    table = spark.createDataFrame([("a.png", "o/a.png", bytearray(small)), ("b.png", "o/b.png", bytearray(large))], "path string, target string, content binary")

    def recognizer():
        def detect(pixels):
            if pixels.shape[1] == 16:
                raise RuntimeError("no")
            return []

        return detect

    got = {r["path"]: (r["status"], r["error"]) for r in plan.processed(table, recognizer).collect()}
    assert got == {"a.png": ("completed", None), "b.png": ("failed", "recognizer: no")}
