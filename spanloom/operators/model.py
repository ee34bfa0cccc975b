"""The model map: a batch translator run in Python workers, call by call, or the built-in test model as a Column expression."""

from __future__ import annotations

import hashlib
import inspect
import logging
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..sources.config import ConfigError

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Call:
    """What one call of the model is asked for besides its texts; None leaves it to the model."""

    budget: int | None = None
    source_language: str | None = None
    target_language: str | None = None
    style: str | None = None
    beams: int | None = None
    #: Seconds that the call may take; an answer that comes later isn't used.
    seconds: float | None = None


class Translator(Protocol):
    """A batch translator: as many texts out as in, None for an item that failed. One that takes only texts is never told of the call."""

    def __call__(self, texts: list[str], call: Call) -> list[str | None]: ...


@dataclass(frozen=True)
class Guard:
    """Bounds on a call: seconds it may take, seconds from which on it is logged as slow, beams that it is asked for."""

    seconds: float = 600.0
    slow: float = 60.0
    beams: int | None = None


def marked(c: Column) -> Column:
    """The test model: every run of Han characters gets a mark before it."""
    return F.regexp_replace(c, f"({P.HAN}+)", "EN:$1")


#: The one model that a worker process holds, by its loader.
_loaded: dict[str, Callable] = {}


def loaded(name: str, loader: Callable) -> Callable:
    """The loader's translator, loaded once in a worker process, which Spark reuses from task to task."""
    if name not in _loaded:
        translate = loader()
        try:
            told = len([p for p in inspect.signature(translate).parameters.values() if p.kind in (p.POSITIONAL_ONLY, p.POSITIONAL_OR_KEYWORD)]) > 1
        except (TypeError, ValueError):
            told = False
        _loaded.clear()
        _loaded[name] = translate if told else lambda texts, call: translate(texts)
    return _loaded[name]


def class_of(error: Exception) -> str:
    """The error class of what a model raised."""
    if isinstance(error, ConfigError):
        return "input"
    return "device" if isinstance(error, MemoryError) or "CUDA" in str(error) else "model_call"


def called(name: str, loader: Callable, texts: list[str], call: Call, slow: float) -> list[tuple[str | None, str | None]]:
    """(output, error class) of each text; nothing that the model or its loader does ends the job."""
    n = len(texts)
    try:
        translate = loaded(name, loader)
    except Exception as e:
        log.exception("the model could not be loaded")
        return [(None, "input" if isinstance(e, ConfigError) else "model_load")] * n
    began = time.monotonic()
    try:
        done = translate(texts, call)
    except Exception as e:
        log.exception("a call of the model failed")
        return [(None, class_of(e))] * n
    taken = time.monotonic() - began
    if taken > slow:
        log.warning("a call of %d texts took %.1f seconds", n, taken)
    if call.seconds is not None and taken > call.seconds:
        return [(None, "deadline")] * n
    if not isinstance(done, list) or len(done) != n:
        return [(None, "batch_count_mismatch")] * n
    return [(t, None) if isinstance(t, str) else (None, "bad_item") for t in done]


def name_of(model: Callable) -> str:
    from pyspark import cloudpickle

    return hashlib.sha256(cloudpickle.dumps(model)).hexdigest()


def _null(x):
    return None if x is None or x != x else x


def model_map(df: DataFrame, text_col: str, out_col: str, model: Callable[[], Translator] | None = None, batch: int = 8, budget: Column | None = None, pair: tuple[Column, Column] | None = None, style: Column | None = None, guard: Guard = Guard(), error_col: str | None = None) -> DataFrame:  # noqa: B008
    """df with the model's output for text_col; null in, null out, and null for an item that the model failed.

    Texts that stand together and agree in languages and style go in calls of ``batch``, each with the largest of
    its budgets. ``model`` is a loader, called once in each worker; without it the test model runs inside the JVM.
    """
    if model is None:
        out = df.withColumn(out_col, marked(F.col(text_col)))
        return out if error_col is None else out.withColumn(error_col, F.lit(None).cast("string"))
    name = name_of(model)

    @F.pandas_udf("output string, error string")
    def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for texts, budgets, *kinds in parts:
            out: list[tuple[str | None, str | None]] = [(None, None)] * len(texts)
            kind = lambda i: tuple(_null(k.iloc[i]) for k in kinds)  # noqa: B023, E731
            for how, at in groupby((i for i, t in enumerate(texts) if _null(t) is not None), kind):
                at = list(at)
                for k in range(0, len(at), batch):
                    some = at[k : k + batch]
                    most = [int(b) for i in some if (b := _null(budgets.iloc[i])) is not None]
                    told = called(name, model, [texts.iloc[i] for i in some], Call(max(most, default=None), *how, guard.beams, guard.seconds), guard.slow)
                    for i, t in zip(some, told, strict=True):
                        out[i] = t
            yield pd.DataFrame(out, columns=["output", "error"], dtype=object)

    none = F.lit(None).cast("string")
    source, target = pair or (none, none)
    budget = F.lit(None).cast("long") if budget is None else budget.cast("long")
    rows = df.withColumn("__told", run(F.col(text_col), budget, source, target, none if style is None else style))
    rows = rows.withColumn(out_col, F.col("__told.output"))
    return (rows if error_col is None else rows.withColumn(error_col, F.col("__told.error"))).drop("__told")


def call_map(plan: DataFrame, by: list[str], order: str, text_col: str, out_col: str, error_col: str, model: Callable[[], Translator] | None, budget: str, pair: tuple[Column, Column], style: Column, guard: Guard = Guard()) -> DataFrame:  # noqa: B008
    """plan with the model's outputs: the rows of one key are one call, in ``order``, its budget the largest of theirs.

    Calls are gathered where a plan's windows have put their rows, without a shuffle of their own.
    """
    if model is None:
        return plan.withColumn(out_col, marked(F.col(text_col))).withColumn(error_col, F.lit(None).cast("string"))
    name = name_of(model)
    rest = [c for c in plan.columns if c not in by]
    calls = plan.withColumns({"__source": pair[0], "__target": pair[1], "__style": style})
    calls = calls.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("__order"), *rest))).alias("__items"), F.max(budget).alias("__budget"), *[F.min(c).alias(c) for c in ("__source", "__target", "__style")])

    @F.pandas_udf("outputs array<string>, errors array<string>")
    def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for some in parts:
            rows = []
            for texts, most, *how in zip(*some, strict=True):
                told = called(name, model, list(texts), Call(int(most), *map(_null, how), guard.beams, guard.seconds), guard.slow)
                rows.append(([t for t, _ in told], [e for _, e in told]))
            yield pd.DataFrame(rows, columns=["outputs", "errors"])

    texts = F.transform("__items", lambda x: x[text_col])
    done = calls.withColumn("__told", run(texts, "__budget", "__source", "__target", "__style"))
    each = done.select(*by, F.explode(F.arrays_zip(F.col("__items").alias("item"), F.col("__told.outputs").alias("output"), F.col("__told.errors").alias("error"))).alias("__x"))
    return each.select(*by, *[F.col(f"__x.item.{c}").alias(c) for c in rest], F.col("__x.output").alias(out_col), F.col("__x.error").alias(error_col)).select(*plan.columns, out_col, error_col)
