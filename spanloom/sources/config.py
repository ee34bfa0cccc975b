"""Settings as frozen dataclasses that check themselves, and the settings' rules as Column expressions."""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F


class ConfigError(ValueError):
    """A setting that can't be used."""


def need(held: bool, what: str) -> None:
    if not held:
        raise ConfigError(what)


@dataclass(frozen=True)
class Generation:
    max_new_tokens: int = 512
    min_new_tokens: int = 1
    multiplier: float = 2.5
    num_beams: int = 4
    length_penalty: float = 1.0
    max_repeated_token_run: int = 3
    max_repeated_ngram_ratio: float = 0.35
    retry_num_beams: int = 1
    retry_max_new_tokens: int = 64
    phrase_multiplier: float = 1.5
    phrase_short_max_new_tokens: int = 32
    phrase_length_penalty: float = 0.8
    phrase_max_expansion: float = 3.0
    phrase_scaffolding: str = "warn"

    def __post_init__(self) -> None:
        need(1 <= self.min_new_tokens <= self.max_new_tokens, "min_new_tokens must lie between 1 and max_new_tokens")
        need(self.retry_max_new_tokens >= self.min_new_tokens, "retry_max_new_tokens must be min_new_tokens at least")
        need(self.multiplier > 0 and self.phrase_multiplier > 0, "multipliers must be positive")
        need(0 <= self.max_repeated_ngram_ratio <= 1, "max_repeated_ngram_ratio must lie between 0 and 1")
        need(self.phrase_scaffolding in ("off", "warn", "retry", "reject"), "phrase_scaffolding must be off, warn, retry or reject")


@dataclass(frozen=True)
class Translation:
    model_name: str = "nllb-200-distilled-600M"
    model_family: str = "nllb"
    source_language: str = "zho_Hans"
    target_language: str = "eng_Latn"
    device: str = "cuda"
    batch_size: int = 8
    max_input_characters: int = 4000
    max_input_tokens: int = 1024
    precision: str = "auto"
    default_style: str = "sentence"
    unknown_token_policy: str = "warn"
    local_files_only: bool = False
    allow_model_download: bool = False
    commercial_use: bool = False
    generation: Generation = field(default_factory=Generation)

    def __post_init__(self) -> None:
        need(self.model_family in ("nllb", "helsinki"), "model_family must be nllb or helsinki")
        need(not (self.local_files_only and self.allow_model_download), "local_files_only excludes allow_model_download")
        need(not (self.commercial_use and self.model_family == "nllb"), "this model family may not be used commercially")
        need(self.default_style in ("sentence", "phrase"), "default_style must be sentence or phrase")
        need(self.unknown_token_policy in ("allow", "warn", "reject"), "unknown_token_policy must be allow, warn or reject")
        need(min(self.batch_size, self.max_input_characters, self.max_input_tokens) >= 1, "sizes must be positive")


@dataclass(frozen=True)
class Structured:
    max_characters: int = 100_000
    max_segment_tokens: int = 450
    max_target_tokens: int = 400
    preserve_patterns: tuple[str, ...] = ()
    translatable_attributes: tuple[str, ...] = ()
    excluded_tags: tuple[str, ...] = ("script", "style", "code", "pre")
    excluded_classes: tuple[str, ...] = ("notranslate",)
    max_retries: int = 1
    batch_size: int = 4
    max_total_seconds: float = 600
    segment_warning_seconds: float = 60

    def __post_init__(self) -> None:
        need(self.max_total_seconds > 0 and self.segment_warning_seconds > 0, "seconds must be positive")
        need(min(self.max_characters, self.max_segment_tokens, self.max_target_tokens, self.batch_size) >= 1, "sizes must be positive")
        need(self.max_retries >= 0, "max_retries must not be negative")
        for p in self.preserve_patterns:
            compiled(p)


@dataclass(frozen=True)
class Images:
    recursive: bool = False
    extensions: tuple[str, ...] = (".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tif", ".tiff")
    min_confidence: float = 0.65
    default_action: str = "translate"
    preserve_terms: tuple[str, ...] = ()
    preserve_patterns: tuple[str, ...] = ()
    preserve_already_target_language: bool = True
    mask_expansion_pixels: int = 3
    minimum_font_size: int = 12
    allow_multiline: bool = True
    overwrite_existing: bool = False
    continue_on_error: bool = True
    log_level: str = "INFO"

    def __post_init__(self) -> None:
        clean = tuple(f".{e.strip().lower().lstrip('.')}" for e in self.extensions)
        object.__setattr__(self, "extensions", clean)
        need(0 <= self.min_confidence <= 1, "min_confidence must lie between 0 and 1")
        need(self.default_action in ("translate", "preserve", "remove", "review"), "default_action must be translate, preserve, remove or review")
        need(self.mask_expansion_pixels >= 0, "mask_expansion_pixels must not be negative")
        need(self.minimum_font_size > 0, "minimum_font_size must be positive")
        need(self.log_level in ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"), "log_level is unknown")
        for p in self.preserve_patterns:
            compiled(p)


@dataclass(frozen=True)
class Settings:
    translation: Translation = field(default_factory=Translation)
    structured: Structured = field(default_factory=Structured)
    images: Images = field(default_factory=Images)


def compiled(pattern: str) -> re.Pattern:
    try:
        return re.compile(pattern)
    except re.error as e:
        raise ConfigError(f"pattern {pattern!r} does not compile: {e}") from e


def built(kind, values: dict):
    """A dataclass from nested plain values; unknown names are errors."""
    known = {f.name: f for f in fields(kind)}
    strange = sorted(set(values) - set(known))
    need(not strange, f"unknown settings: {strange}")
    out = {}
    for k, v in values.items():
        default = getattr(kind(), k)
        out[k] = built(type(default), v) if is_dataclass(default) else tuple(v) if isinstance(default, tuple) else v
    return kind(**out)


def load(path: str | None = None, root: str = ".") -> Settings:
    """Settings from a path that must exist, else from config.json below root, else the built-in ones."""
    found = Path(path) if path else Path(root, "config.json")
    if not found.exists():
        need(path is None, f"no such file: {path}")
        return Settings()
    try:
        values = json.loads(found.read_text(encoding="utf-8"))
    except json.JSONDecodeError as e:
        raise ConfigError(f"{found} is not JSON: {e}") from e
    return built(Settings, values)


def resolved_path(value: str, folder: str) -> Path:
    """Variables and home expanded; a relative path is below the configuration's folder."""
    path = Path(os.path.expanduser(os.path.expandvars(value)))
    return path if path.is_absolute() else Path(folder, path)


def style(asked: Column, default: str = "sentence") -> Column:
    """struct(style, error): nothing asked is the default, another name an error."""
    good = asked.isin("sentence", "phrase")
    return F.struct(F.when(asked.isNull(), default).when(good, asked).alias("style"), F.when(asked.isNotNull() & ~good, "invalid_style").alias("error"))


# The short names of languages.
ALIASES = {"zh": "zho_Hans", "zh-cn": "zho_Hans", "zh_cn": "zho_Hans", "en": "eng_Latn", "en-us": "eng_Latn", "en_us": "eng_Latn"}


def language(asked: Column) -> Column:
    """The model's code of a language; others stay as they are."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])[F.lower(asked)], asked)


def device(asked: Column, devices: Column, fall_back: Column, precision: Column) -> Column:
    """struct(resolved, error, precision): a GPU needs its number to exist, or leave to fall back to the CPU."""
    number = F.coalesce(F.regexp_extract(asked, r"cuda:(\d+)", 1).try_cast("int"), F.lit(0))
    there = (asked != "cpu") & (devices > number)
    resolved = F.when(asked == "cpu", "cpu").when(there, asked).when(fall_back, "cpu")
    half = (precision == "float16") & there
    return F.struct(resolved.alias("resolved"), F.when(resolved.isNull(), "device_unavailable").alias("error"), F.when(half, "float16").otherwise("float32").alias("precision"))
