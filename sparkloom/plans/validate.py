"""Checks of a caller's input before any plan is built (FLT-14..FLT-16)."""

from __future__ import annotations

import logging
import os
import re
from dataclasses import dataclass, field
from pathlib import Path


SOURCE_TYPES = ("rust", "simd", "c", "docs")
_CONSTANT = re.compile(r"^[A-Z][A-Z0-9_]*$")
_FUNCTION = re.compile(r"^[a-z_][a-z0-9_]*$")


class InputError(ValueError):
    pass


def _sized(text: str, most: int, what: str) -> str:
    if not isinstance(text, str) or not 1 <= len(text) <= most:
        raise InputError(f"{what} must have 1 to {most} characters")
    return text


@dataclass(frozen=True)
class Search:
    query: str
    limit: int = 5
    source_type: str | None = None

    def __post_init__(self) -> None:
        _sized(self.query, 1000, "query")
        if isinstance(self.limit, bool) or not isinstance(self.limit, int) or not 1 <= self.limit <= 50:
            raise InputError("limit must be 1 to 50")
        if self.source_type is not None:
            object.__setattr__(self, "source_type", self.source_type.lower())
            if self.source_type not in SOURCE_TYPES:
                raise InputError(f"source_type must be one of {SOURCE_TYPES}")


def constant_name(name: str) -> str:
    if not _CONSTANT.match(_sized(name, 100, "name")):
        raise InputError("a constant's name is in upper case")
    return name


def function_name(name: str) -> str:
    if not _FUNCTION.match(_sized(name, 100, "name")):
        raise InputError("a function's name is in lower case")
    return name


def topic(text: str) -> str:
    return _sized(text, 50, "topic").lower().strip()


def client(text: str) -> str:
    return _sized(text, 50, "name").lower().strip()


def inside(base: str, path: str) -> Path:
    """``path`` under ``base``, also after links are followed (FLT-14)."""
    root = Path(base).resolve()
    found = (root / path).resolve()
    if found != root and root not in found.parents:
        raise InputError(f"{path!r} leaves {base!r}")
    return found


@dataclass
class Config:
    """Index settings; out-of-range values raise, odd ones are told in ``warnings``."""

    model: str = "hashing"
    batch_size: int = 32
    chunk_size: int = 1000
    chunk_overlap: int = 200
    #: What was odd about the file that they come from.
    warnings: list[str] = field(default_factory=list, compare=False)

    def problems(self, models: dict[str, str | None] | None = None) -> list[str]:
        """Raises on settings that can't work; returns warnings."""
        if self.batch_size < 1:
            raise InputError("batch_size must be at least 1")
        if not 100 <= self.chunk_size <= 10_000:
            raise InputError("chunk_size must be 100 to 10000")
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise InputError("chunk_overlap must be 0 or more, and less than chunk_size")
        told = []
        if models is not None:
            if self.model not in models:
                told.append(f"unknown model {self.model}")
            elif (variable := models[self.model]) and not os.environ.get(variable):
                raise InputError(f"{self.model} needs {variable}")
        if self.batch_size > 256:
            told.append("batch_size over 256 may exhaust memory")
        return told


MAX_CONFIG_BYTES = 1 << 20
SETTINGS = {"embedding": {"model", "batch_size"}, "chunking": {"chunk_size", "chunk_overlap"}}
SECTIONS = set(SETTINGS)
PREFIX = "SPARKLOOM_"


def load_config(path: str) -> Config:
    """A YAML file with embedding and chunking sections, then the environment (SRC-16).

    A file that is missing or no YAML mapping gives the defaults; one over the size limit raises.
    """
    import yaml

    config = Config()
    file = Path(path)
    data: object = None
    if file.exists():
        if file.stat().st_size > MAX_CONFIG_BYTES:
            raise InputError("configuration file too large")
        try:
            data = yaml.safe_load(file.read_text())
        except (OSError, yaml.YAMLError, UnicodeDecodeError):
            data = None
    if isinstance(data, dict):
        config.warnings += [f"unknown setting {k}" for k in sorted(map(str, unknown_keys(data, SECTIONS)))]
        for name, allowed in SETTINGS.items():
            if isinstance(data.get(name), dict):
                config.warnings += [f"unknown setting {name}.{k}" for k in sorted(map(str, unknown_keys(data[name], allowed)))]
            elif data.get(name) is not None:
                config.warnings.append(f"{name} is no mapping")
                data[name] = {}
        embedding, chunks = data.get("embedding") or {}, data.get("chunking") or {}
        config.model = embedding.get("model", config.model)
        config.batch_size = embedding.get("batch_size", config.batch_size)
        config.chunk_size = chunks.get("chunk_size", config.chunk_size)
        config.chunk_overlap = chunks.get("chunk_overlap", config.chunk_overlap)
    config.model = os.environ.get(f"{PREFIX}EMBEDDING_MODEL", config.model)
    if (size := os.environ.get(f"{PREFIX}BATCH_SIZE", "")).isdigit():
        config.batch_size = int(size)
    config.warnings += config.problems()
    for told in config.warnings:
        logging.getLogger("sparkloom.config").warning(told)
    return config


def unknown_keys(data: dict, allowed: set[str]) -> set[str]:
    """Keys that no setting has (SET-03, AGG-13)."""
    return set(data) - allowed


def save_config(config: Config, path: str) -> None:
    import yaml

    Path(path).write_text(yaml.safe_dump({"embedding": {"model": config.model, "batch_size": config.batch_size}, "chunking": {"chunk_size": config.chunk_size, "chunk_overlap": config.chunk_overlap}}, sort_keys=False))
