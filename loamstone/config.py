"""Settings from a TOML file that an environment variable names, else defaults."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields

from loamstone.errors import ConfigError

VARIABLE = "LOAMSTONE_CONFIG"


@dataclass
class Chunking:
    chunk_size: int = 64
    overlap: int = 0


@dataclass
class Memory:
    default_collection: str = "agent-memory"
    min_signal_chars: int = 80
    detail_chars: int = 800


@dataclass
class Batches:
    max_docs: int = 100
    max_text_bytes: int = 32 * 1024 * 1024


@dataclass
class Folders:
    include: list[str] = field(default_factory=lambda: ["**/*.md", "**/*.txt"])
    exclude: list[str] = field(default_factory=list)
    max_files: int = 20_000
    max_file_bytes: int = 10 * 1024 * 1024


@dataclass
class Config:
    root: str = "collections"
    buckets: int = 16
    session_ttl_s: int = 600
    chunking: Chunking = field(default_factory=Chunking)
    memory: Memory = field(default_factory=Memory)
    batches: Batches = field(default_factory=Batches)
    folders: Folders = field(default_factory=Folders)


def _fill(cls, data: dict, where: str):
    known = {f.name: f for f in fields(cls)}
    unknown = set(data) - set(known)
    if unknown:
        raise ConfigError(f"unknown settings in {where}: {sorted(unknown)}")
    parts = {"chunking": Chunking, "memory": Memory, "batches": Batches, "folders": Folders}
    return cls(**{k: _fill(parts[k], v, k) if k in parts and isinstance(v, dict) else v for k, v in data.items()})


def load(path: str | None = None) -> Config:
    path = path or os.environ.get(VARIABLE)
    if not path:
        return Config()
    try:
        with open(path, "rb") as f:
            return _fill(Config, tomllib.load(f), path)
    except (OSError, tomllib.TOMLDecodeError) as e:
        raise ConfigError(f"{path}: {e}") from e
