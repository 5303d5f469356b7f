"""Settings of the comparison: defaults, then a JSON file, then environment variables."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    max_tokens: int = 800
    overlap: int = 50
    min_chunk_size: int = 100
    sentence_split: bool = True
    embed_weight: float = 0.6
    string_weight: float = 0.4
    exact: float = 0.92
    partial: float = 0.75
    gap: float = 0.15
    remove_patterns: tuple[str, ...] = ()


def load(paths: Iterable[str] = ("lexiloom.json", "configs/lexiloom.json"), environment: Mapping[str, str] = os.environ, prefix: str = "LEXILOOM_") -> Settings:
    """Settings of the first of `paths` that is there, overridden by variables named after them; names
    that aren't settings are left aside, lists come as JSON."""
    found = Settings()
    for path in paths:
        if os.path.isfile(path):
            with open(path, encoding="utf-8") as f:
                found = _with(found, json.load(f))
            break
    return _with(found, {f.name: environment[prefix + f.name.upper()] for f in fields(Settings) if prefix + f.name.upper() in environment})


def _with(settings: Settings, values: Mapping[str, object]) -> Settings:
    changed = {}
    for f in fields(Settings):
        if f.name in values:
            old, new = getattr(settings, f.name), values[f.name]
            if isinstance(old, tuple):
                changed[f.name] = tuple(json.loads(new) if isinstance(new, str) else new)
            elif isinstance(old, bool):
                changed[f.name] = new if isinstance(new, bool) else str(new).lower() in ("1", "true", "yes", "on")
            else:
                changed[f.name] = type(old)(new)
    return replace(settings, **changed)
