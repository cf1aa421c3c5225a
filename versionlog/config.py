"""Engine settings, as a JSON file over defaults."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class Config:
    """Only settings that mean something on Spark; unknown keys of a file are ignored.

    Spark itself decides on buffering structures, caches and file layouts.
    """

    wal_size: int = 10_000
    memtable_size: int = 100
    memtable_max_instances: int = 3
    lru_cache_max_size: int = 5
    index_degree: int = 5
    summary_degree: int = 5
    lsm_tree_max_depth: int = 7
    number_of_tokens: int = 100_000
    token_reset_interval: int = 60
    lsm_first_level_size: int = 10
    lsm_growth_factor: int = 9
    lsm_compaction_type: str = "sizetiered"

    @classmethod
    def load(cls, path: str | Path) -> Config:
        """Defaults, overridden by the file's keys (in any case, with or without underscores)."""
        names = {f.name.replace("_", ""): f.name for f in fields(cls)}
        given = json.loads(Path(path).read_text())
        return cls(**{names[k]: v for key, v in given.items() if (k := key.lower().replace("_", "")) in names})
