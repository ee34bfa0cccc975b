"""Bounded records of requests: what a record may hold, and how it is cut to fit."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Budget:
    entries: int = 8
    segments: int = 128
    items: int = 32
    keys: int = 32
    string_bytes: int = 256
    entry_bytes: int = 64 * 1024
    depth: int = 12


LIMITS = Budget()


def bounded(value: Any, limits: Budget = LIMITS, depth: int = 0) -> Any:
    """value with long strings, lists, maps and nestings cut, each cut marked."""
    if value is None or isinstance(value, bool | int | float):
        return value
    if isinstance(value, str):
        raw, mark = value.encode(), "…"
        return value if len(raw) <= limits.string_bytes else raw[: limits.string_bytes - len(mark.encode())].decode(errors="ignore") + mark
    if depth > limits.depth:
        return {"__truncated__": True, "reason": "max_depth"}
    if isinstance(value, dict):
        kept = {str(k): bounded(v, limits, depth + 1) for k, v in list(value.items())[: limits.keys]}
        return kept | ({"__truncated_keys__": True} if len(value) > limits.keys else {})
    if isinstance(value, list | tuple):
        return [bounded(v, limits, depth + 1) for v in value[: limits.items]] + ([{"__truncated_items__": True}] if len(value) > limits.items else [])
    return {"__unsupported__": type(value).__name__[:64]}


SUMMARY = ("invocation", "duration_seconds", "segment_count", "retry_count", "fallback_count", "output_fingerprint")


def fitted(record: dict, limits: Budget = LIMITS) -> dict:
    """record if its JSON fits, else with the first 64, 32 ... 1 segments, else its summary."""
    size = lambda r: len(json.dumps(r, ensure_ascii=False, separators=(",", ":")).encode())
    if size(record) <= limits.entry_bytes:
        return record
    some = record.get("segments")
    if isinstance(some, list):
        for k in range(6, -1, -1):
            less = record | {"segments": some[: 2**k], "segments_truncated": len(some) > 2**k}
            if size(less) <= limits.entry_bytes:
                return less
    return {k: record.get(k) for k in SUMMARY} | {"__truncated__": True, "serialized_bytes": size(record)}


def record(column: Column) -> Column:
    """A JSON column with every record bounded and fitted."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        one = lambda t: None if t is None else json.dumps(fitted(bounded(json.loads(t))), ensure_ascii=False)
        return texts.map(one)

    return run(column)
