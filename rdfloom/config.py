"""Settings, from a TOML file or by hand."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, fields
from pathlib import Path


@dataclass
class Settings:
    """max_rows 0: no limit; query_timeout in seconds, 0: none; model: folder or address of a model to materialise paths from.

    A query reserves memory_mb_least at least and memory_mb at most, of memory_mb for all; it waits queue_timeout seconds for room.
    """

    host: str = "127.0.0.1"
    port: int = 7878
    max_rows: int = 0
    query_timeout: float = 0.0
    max_concurrent: int = 8
    memory_mb: int = 4096
    memory_mb_least: int = 256
    queue_timeout: float = 60.0
    max_cross_bytes: int = 64 << 20
    shuffle_partitions: int = 0
    model: str = ""

    def __post_init__(self) -> None:
        for name in ("max_rows", "query_timeout", "max_concurrent", "memory_mb", "memory_mb_least", "queue_timeout", "max_cross_bytes", "shuffle_partitions"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} can't be negative")

    @classmethod
    def read(cls, path: str) -> Settings:
        """Keys may stand at the top or in any section; unknown ones are refused."""
        flat: dict = {}
        for k, v in tomllib.loads(Path(path).read_text()).items():
            flat.update(v if isinstance(v, dict) else {k: v})
        known = {f.name for f in fields(cls)}
        if extra := sorted(set(flat) - known):
            raise ValueError(f"unknown settings: {', '.join(extra)}")
        return cls(**flat)
