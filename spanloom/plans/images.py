"""Image folders end to end: recognize, classify, translate, mask, inpaint, draw, record.

One Python pass finds the regions, the JVM classifies, translates and lays them out, and a second pass, with
each image beside its regions, makes the pictures. An image that fails has an error; the others go on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import layout as L
from ..functions import text as T
from ..operators import imaging
from ..operators.model import model_map
from ..sources import png
from ..sources.config import Images

FOUND = "path string, width int, height int, error string, regions array<struct<id:string,source_text:string,confidence:double,polygon:array<array<double>>>>"
MADE = "path string, target string, status string, error string, image binary, mask binary, cleaned binary"


def detected(images: DataFrame, recognizer: Callable[[], imaging.Recognizer], settings: Images) -> DataFrame:
    """The regions of each image (path, content). Regions are numbered before the confident ones are chosen."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detect = recognizer()  # a recognizer that can't be loaded ends the job: no image could be read
        for part in parts:
            rows = []
            for path, content in zip(part["path"], part["content"], strict=True):
                try:
                    pixels = png.decode(bytes(content))
                    found = [{"id": f"text_{i:03d}", "source_text": t, "confidence": float(c), "polygon": [[float(x), float(y)] for x, y in p]} for i, (t, c, p) in enumerate(detect(pixels))]
                    rows.append((path, pixels.shape[1], pixels.shape[0], None, [r for r in found if r["confidence"] >= settings.min_confidence]))
                except Exception as e:  # an image fails alone, whatever its recognizer raises
                    rows.append((path, None, None, f"{'input' if isinstance(e, ValueError) else 'recognizer'}: {e}", None))
            yield pd.DataFrame(rows, columns=["path", "width", "height", "error", "regions"])

    return images.select("path", "content").mapInPandas(run, FOUND)


def prepared(found: DataFrame, settings: Images, model: Callable | None = None) -> DataFrame:
    """path, fault, regions: each region with its action, text, font size and lines. Images without text, or that failed (fault), have none."""
    each = found.select("path", "error", F.posexplode_outer("regions").alias("n", "r"))
    rule = T.region_action(F.col("r.source_text"), list(settings.preserve_terms), list(settings.preserve_patterns), settings.default_action, settings.preserve_already_target_language)
    each = each.withColumn("rule", rule).withColumn("asked", F.when(F.col("rule.action") == "translate", F.col("r.source_text")))
    each = model_map(each, "asked", "text", model).withColumn("rect", L.rect(F.col("r.polygon")))
    each = each.withColumn("font_size", L.font_size(F.col("rect.width"), F.coalesce("text", F.lit("")), settings.minimum_font_size))
    wrap = F.lit(settings.allow_multiline) & (F.length("text") > 10)
    lines = F.when(wrap, L.wrapped(F.col("text"), F.floor(F.col("rect.width") / (F.col("font_size") * 0.5)))).otherwise(F.array("text"))
    region = F.struct("n", "r.id", "r.source_text", "r.confidence", "r.polygon", "rule.action", F.col("rule.reason").alias("action_reason"), "text", "rect.cx", "rect.cy", "rect.width", "rect.height", "font_size", lines.alias("lines"))
    return each.groupBy("path").agg(F.max("error").alias("fault"), F.array_sort(F.collect_list(F.when(F.col("n").isNotNull(), region))).alias("regions"))


def processed(images: DataFrame, recognizer: Callable[[], imaging.Recognizer], settings: Images | None = None, model: Callable | None = None, inpaint: imaging.Inpainter = imaging.inward, render: imaging.Renderer = imaging.bars) -> DataFrame:
    """MADE for each image (path, target, content)."""
    settings = settings or Images()
    found = detected(images, recognizer, settings)
    rows = images.select("path", "target", "content").join(prepared(found, settings, model), "path", "left")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for path, target, content, regions, fault in zip(part["path"], part["target"], part["content"], part["regions"], part["fault"], strict=True):
                if fault is not None:
                    out.append((path, target, "failed", fault, None, None, None))
                    continue
                try:
                    if regions is None or not len(regions):  # without text an image goes through as it is
                        png.dimensions(bytes(content))
                        out.append((path, target, "completed", None, bytes(content), None, None))
                        continue
                    pixels = png.decode(bytes(content))
                    told = [r if isinstance(r, dict) else r.asDict() for r in regions]
                    mask = imaging.text_mask(pixels.shape[:2], told, settings.mask_expansion_pixels)
                    clean = inpaint(pixels, mask) if mask.any() else pixels
                    done = imaging.revised(clean, told, render)
                    if done.shape != pixels.shape:
                        raise ValueError("the size changed")
                    out.append((path, target, "completed", None, png.encode(done), png.encode(mask[..., None]), png.encode(np.ascontiguousarray(clean))))
                except Exception as e:  # an image fails alone, whatever inpainter or renderer raise
                    out.append((path, target, "failed", f"{'input' if isinstance(e, ValueError) else 'render'}: {e}", None, None, None))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in MADE.split(", ")])

    return rows.mapInPandas(run, MADE)


def summary(done: DataFrame, skipped: int = 0) -> DataFrame:
    """total, succeeded, failed, skipped, has_failures. Images that were there already count as succeeded."""
    failed = F.count_if(F.col("status") == "failed")
    return done.agg((F.count("*") + skipped).alias("total"), (F.count_if(F.col("status") == "completed") + skipped).alias("succeeded"), failed.alias("failed"), F.lit(skipped).alias("skipped"), (failed > 0).alias("has_failures"))


def table_recognizer(regions: dict[str, list[tuple[str, float, list[list[float]]]]]) -> Callable[[], imaging.Recognizer]:
    """A recognizer that knows the regions of images by the SHA-256 of their pixels."""
    import hashlib

    return lambda: lambda pixels: regions.get(hashlib.sha256(pixels.tobytes()).hexdigest(), [])
