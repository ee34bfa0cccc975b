"""Model families: what a family asks of its settings, its language codes and generation arguments."""

from __future__ import annotations

from dataclasses import dataclass

from ..sources.config import ALIASES, ConfigError, Generation, Translation, need


@dataclass(frozen=True)
class Nllb:
    """Many languages; the target's code is forced as the first token."""

    settings: Translation

    def __post_init__(self) -> None:
        need("nllb" in self.settings.model_name.lower(), "the model's name must hold nllb")
        need(not self.settings.commercial_use, "this family may not be used commercially")

    def source(self, code: str | None = None) -> str | None:
        code = code or self.settings.source_language
        return ALIASES.get(code.lower(), code)

    def arguments(self, vocabulary: dict[str, int], target: str | None, generation: Generation) -> dict:
        code = target or self.settings.target_language
        code = ALIASES.get(code.lower(), code)
        if code not in vocabulary:
            raise ConfigError(f"the vocabulary has no language {code}")
        return {"forced_bos_token_id": vocabulary[code], "num_beams": generation.num_beams, "length_penalty": generation.length_penalty, "do_sample": False}


@dataclass(frozen=True)
class Helsinki:
    """One pair of languages; no language codes."""

    settings: Translation

    def __post_init__(self) -> None:
        need("opus-mt-zh-en" in self.settings.model_name.lower(), "the model's name must hold opus-mt-zh-en")

    def source(self, code: str | None = None) -> str | None:
        return None

    def arguments(self, vocabulary: dict[str, int], target: str | None, generation: Generation) -> dict:
        return {"num_beams": generation.num_beams, "length_penalty": generation.length_penalty, "do_sample": False}


FAMILIES = {"nllb": Nllb, "helsinki": Helsinki}


def family(settings: Translation) -> Nllb | Helsinki:
    return FAMILIES[settings.model_family](settings)


def unknown_tokens(ids: list[int], unknown: int | None, policy: str = "warn") -> tuple[int, str | None]:
    """How many ids are unknown, and what the policy says: nothing, warn or an error class."""
    n = 0 if unknown is None else ids.count(unknown)
    return n, None if not n or policy == "allow" else "warn" if policy == "warn" else "quality"
