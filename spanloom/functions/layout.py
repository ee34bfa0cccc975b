"""Region geometry, font size, wrapping, paths and sort keys as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rect(polygon: Column) -> Column:
    """struct(cx, cy, width, height, angle): mean point and extent of a polygon's points."""
    axis = lambda k: F.transform(polygon, lambda p: F.element_at(p, k + 1))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    extent = lambda a: F.array_max(a) - F.array_min(a)
    x, y = axis(0), axis(1)
    return F.struct(mean(x).alias("cx"), mean(y).alias("cy"), extent(x).alias("width"), extent(y).alias("height"), F.lit(0.0).alias("angle"))


def font_size(width: Column, text: Column, least: int = 12, most: int = 48, decimal: bool = False) -> Column:
    """The largest size at which text, 0.6 of it a character, is as wide; ``decimal``: 0.6 exactly, not the double next to it."""
    n = F.length(text)
    fits = F.greatest(F.lit(least), F.least(F.lit(most), F.floor(width / (n * 6 / 10 if decimal else n * 0.6))))
    return F.when((width <= 0) | (n <= 0), most).otherwise(fits).cast("long")


def wrapped(text: Column, chars: Column) -> Column:
    """Lines of whole words, of so many characters at most where a word allows it."""
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"))

    def add(s: Column, w: Column) -> Column:
        fits = F.length(s["line"]) + F.length(w) + 1 <= chars
        line = F.when(fits, F.trim(F.concat(s["line"], F.lit(" "), w))).otherwise(w)
        lines = F.when(fits | (s["line"] == ""), s["lines"]).otherwise(F.concat(s["lines"], F.array(s["line"])))
        return F.struct(lines.alias("lines"), line.alias("line"))

    parts = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    done = F.aggregate(parts, start, add, lambda s: F.when(s["line"] == "", s["lines"]).otherwise(F.concat(s["lines"], F.array(s["line"]))))
    return F.when((chars <= 0) | (F.size(done) == 0), F.array(text)).otherwise(done)


def mask_box(polygon: Column, width: Column, height: Column, grow: int = 3) -> Column:
    """struct(x0, y0, x1, y1, area) of an axis-aligned region's mask: clipped to the image, grown, clipped again."""
    axis = lambda k, size: F.transform(polygon, lambda p: F.least(size - 1, F.greatest(F.lit(0), F.element_at(p, k + 1).cast("int"))))
    x, y = axis(0, width), axis(1, height)
    x0, y0 = F.greatest(F.lit(0), F.array_min(x) - grow), F.greatest(F.lit(0), F.array_min(y) - grow)
    x1, y1 = F.least(width - 1, F.array_max(x) + grow), F.least(height - 1, F.array_max(y) + grow)
    fields = {"x0": x0, "y0": y0, "x1": x1, "y1": y1, "area": (x1 - x0 + 1) * (y1 - y0 + 1)}
    return F.struct(*[c.cast("long").alias(k) for k, c in fields.items()])


def natural_key(name: Column) -> Column:
    """A text that sorts as the name does when its numbers count as numbers."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(p)), "")


def output_path(path: Column) -> Column:
    """The same file below ``<folder>_processed``."""
    return F.regexp_replace(path, r"^(.*?)/([^/]*)\z", "$1_processed/$2")
