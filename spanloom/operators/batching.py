"""Batch planning over segments: budgets, classes, chunks and model calls in first-seen order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import budget


def planned(segments: DataFrame, doc: str = "doc_id", seq: str = "seq", tokens: str = "tokens", size: int = 4, style: Column | None = None, pair: list[str] = []) -> DataFrame:  # noqa: B006
    """segments with budget, bucket, chunk and batch_index.

    A document's segments are cut into chunks of ``size`` in order; a chunk's segments of one language pair
    and budget class are one model call; calls are numbered in the order in which they are first seen.
    ``seq`` counts from 1. One shuffle, by document; windows of the same key reuse it.
    """
    style = F.lit("sentence") if style is None else style
    rows = segments.withColumn("budget", budget.target_budget(F.col(tokens), style))
    rows = rows.withColumn("bucket", budget.bucket(F.col("budget"))).withColumn("chunk", F.floor((F.col(seq) - 1) / size).cast("long"))
    first = F.min(seq).over(W.partitionBy(doc, "chunk", *pair, "bucket"))
    rows = rows.withColumn("__first", first)
    return rows.withColumn("batch_index", F.dense_rank().over(W.partitionBy(doc).orderBy("__first")).cast("long")).drop("__first")


def metrics(plan: DataFrame, doc: str = "doc_id", seq: str = "seq", tokens: str = "tokens") -> DataFrame:
    """A row for each model call: items, budgets, classes and source tokens."""
    each = F.array_sort(F.collect_list(F.struct(seq, "budget", "bucket")))
    rows = plan.groupBy(doc, "batch_index").agg(F.count("*").alias("items"), F.max("bucket").alias("max_target_budget"), F.sum(tokens).alias("source_tokens"), each.alias("each"))
    return rows.select(doc, "batch_index", "items", "max_target_budget", "source_tokens", F.transform("each", lambda x: x["budget"]).alias("budgets"), F.transform("each", lambda x: x["bucket"]).alias("buckets"))


def packed(units: Column, most: int) -> Column:
    """array of the chunk of each unit (struct with tokens): units fill a chunk in order while it has room."""
    start = F.struct(F.lit(0).cast("long").alias("chunk"), F.lit(0).cast("long").alias("used"), F.array().cast("array<bigint>").alias("out"))

    def add(s: Column, u: Column) -> Column:
        fits = (s["used"] == 0) | (s["used"] + u["tokens"] <= most)
        chunk = F.when(fits, s["chunk"]).otherwise(s["chunk"] + 1)
        used = F.when(fits, s["used"] + u["tokens"]).otherwise(u["tokens"])
        return F.struct(chunk.alias("chunk"), used.alias("used"), F.concat(s["out"], F.array(chunk)).alias("out"))

    return F.aggregate(units, start, add, lambda s: s["out"])
