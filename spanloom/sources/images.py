"""Image files as rows, and artifacts written back."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.layout import natural_key, output_path
from .config import Images


def is_image(path: Column, extensions: Iterable[str] = Images().extensions) -> Column:
    """By its suffix, in either case, and not below a folder of results."""
    names = "|".join(e.lstrip(".") for e in extensions)
    return path.rlike(rf"(?i)\.({names})\z") & ~F.contains(path, F.lit("_processed/"))


def scan(spark: SparkSession, folder: str, settings: Images | None = None) -> DataFrame:
    """path, target, length, modificationTime, content of a folder's images, in natural order of their names.

    A single file is a folder of one. ``content`` is read only if it is asked for.
    """
    settings = settings or Images()
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", settings.recursive).load(folder)
    found = rows.filter(is_image(F.col("path"), settings.extensions)).withColumn("target", output_path(F.col("path")))
    return found.orderBy(natural_key(F.regexp_extract("path", r"[^/]*\z", 0)), "path")


def pending(images: DataFrame, results: DataFrame, overwrite: bool = False) -> DataFrame:
    """Images without a result yet; all of them if results may be overwritten."""
    return images if overwrite else images.join(results.select("target"), "target", "left_anti")


def write_artifacts(rows: DataFrame, folder: str) -> None:
    """Rows of artifact (metadata, mask, cleaned), name and content, below a folder for each artifact."""
    rows.write.partitionBy("artifact").mode("append").parquet(folder)


def write_json(rows: DataFrame, column: str, folder: str) -> None:
    rows.select(F.to_json(column).alias("value")).write.mode("overwrite").text(folder)


def read_json(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(folder)
