"""A model's files on disk: which are missing."""

from __future__ import annotations

from pathlib import Path

# What a usable model folder holds, any of each group.
NEEDED = (("config.json",), ("model.safetensors", "pytorch_model.bin", "model.safetensors.index.json", "pytorch_model.bin.index.json"), ("tokenizer.json", "sentencepiece.bpe.model", "source.spm", "vocab.json"))


def missing(folder: str) -> list[str]:
    """The groups of which the folder holds no file that has content."""
    there = {p.name for p in Path(folder).glob("*") if p.is_file() and p.stat().st_size}
    return [" or ".join(group) for group in NEEDED if not there & set(group)]
