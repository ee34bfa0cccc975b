"""The request service: answers, states and records, over batches and streams of requests.

A request is a row (request_id, text, format, source_language, target_language, style); an answer is a row
(request_id, translation, status, error_class). A stream runs the very plans of the batch in foreachBatch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.plain import translate
from ..sources.config import Translation, style

REQUEST = "request_id string, text string, format string, source_language string, target_language string, style string"
# The status that each class of errors answers with; any other is 500.
STATUS = {"input": 400, "quality": 422, "device": 503, "model_load": 503, "document_too_long": 422, "not_a_string": 422, "request_invalid": 422}


#: What a model call can end with that is nobody's input.
CALL_FAULTS = ("model_call", "bad_item", "batch_count_mismatch")


def status_of(error_class: Column) -> Column:
    table = F.create_map(*[x for k, v in STATUS.items() for x in (F.lit(k), F.lit(v).cast("long"))])
    return F.when(error_class.isNull(), F.lit(200).cast("long")).otherwise(F.coalesce(table[error_class], F.lit(500).cast("long")))


def answers(requests: DataFrame, model: Callable | None = None, held: list[DataFrame] | None = None, translation: Translation | None = None) -> DataFrame:
    """An answer for every request, in its own languages; each fails alone, requests that share an id too. ``held`` gets the tables that are persisted on the way."""
    from ..plans.structured import translate_html

    translation = translation or Translation()
    kind = F.coalesce("format", F.lit("plain"))
    rows = requests.withColumn("__style", style(F.col("style"))).withColumn("__kind", kind)
    bad = F.when(F.col("text").isNull() | ~F.col("__kind").isin("plain", "html"), "request_invalid").when(F.col("__style.error").isNotNull(), "input")
    rows = rows.withColumn("__bad", bad)
    refused = rows.filter(F.col("__bad").isNotNull()).select("request_id", F.lit(None).cast("string").alias("translation"), F.col("__bad").alias("error_class"))
    good = rows.filter(F.col("__bad").isNull())
    pair = tuple(F.coalesce(F.col(c), F.lit(default)) for c, default in (("source_language", translation.source_language), ("target_language", translation.target_language)))
    plain = translate(good.filter("__kind = 'plain'"), "text", model, F.col("__style.style"), retry=model is not None, held=held, translation=translation, pair=pair)
    error = F.when(F.col("error").isin("degenerate_output", "phrase_rejected"), "quality").when(F.col("error").isin("device", "model_load", "deadline"), F.col("error")).when(F.col("error").isin(*CALL_FAULTS), "other").when(F.col("error").isNotNull(), "input").when(F.col("translation").isNull(), "other")
    plain = plain.select("request_id", "translation", error.alias("error_class"))
    pages = good.filter("__kind = 'html'").select(F.col("request_id").alias("doc_id"), F.col("text").alias("html"), "source_language", "target_language")
    html = translate_html(pages, model, held=held, translation=translation)
    html = html.select(F.col("doc_id").alias("request_id"), F.col("html").alias("translation"), F.col("error").alias("error_class"))
    out = refused.unionByName(plain).unionByName(html)
    return out.withColumn("status", status_of(F.col("error_class"))).withColumn("code", F.coalesce("error_class", F.lit("ok")))


def serve(spark: SparkSession, requests: str, results: str, checkpoint: str, model: Callable | None = None, once: bool = False) -> StreamingQuery:
    """Answer JSON requests as their files arrive; results are Parquet, one folder a batch, so a repeated batch replaces its own."""
    stream = spark.readStream.schema(REQUEST).json(requests)

    def answer(batch: DataFrame, number: int) -> None:
        held: list[DataFrame] = [batch.persist()]
        answers(batch, model, held).write.mode("overwrite").parquet(f"{results}/batch={number}")
        for df in held:
            df.unpersist()

    writer = stream.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def last_records(stream: DataFrame, key: str, order: str, value: str, keep: int = 8) -> DataFrame:
    """The last ``keep`` values of each key as a stream, held in state (its size is bounded by ``keep``)."""

    def update(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for part in parts:
            held += list(zip(part[order].astype(str), part[value].astype("int64"), strict=True))
        held = sorted(held)[-keep:]
        orders, values = [h[0] for h in held], [int(h[1]) for h in held]
        state.update((orders, values))
        yield pd.DataFrame({key: [name[0]], "records": [values]})

    kind = stream.schema[key].dataType.simpleString()
    shape = f"{key} {kind}, records array<bigint>"
    return stream.groupBy(key).applyInPandasWithState(update, shape, "orders array<string>, records array<bigint>", "update", GroupStateTimeout.NoTimeout)


def health(spark: SparkSession, model: str = "test", loaded: bool = True) -> DataFrame:
    """One row: whether the service can answer, and with what."""
    return spark.range(1).select(F.lit("ok" if loaded else "starting").alias("status"), F.lit(model).alias("model"), F.lit(spark.version).alias("engine"), F.lit(spark.sparkContext.defaultParallelism).alias("slots"))


def cache_status(spark: SparkSession, folder: str) -> DataFrame:
    """One row: whether a model's files are all there, without loading it."""
    from ..sources.snapshot import missing

    gone = missing(folder)
    return spark.range(1).select(F.lit(folder).alias("path"), F.lit(not gone).alias("complete"), F.lit(", ".join(gone) or None).cast("string").alias("error"))
