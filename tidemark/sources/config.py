"""Where the stores lie."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True)
class DataPaths:
    raw: str
    processed: str
    derived: str
    external: str
    charts: str


def load(path: str) -> DataPaths:
    """From a file of ``name: value`` lines, optionally under ``data_paths:``; a missing file or name is an error."""
    found: dict[str, str] = {}
    for line in Path(path).read_text().splitlines():
        name, mark, value = line.partition("#")[0].partition(":")
        if mark and value.strip():
            found[name.strip()] = value.strip().strip("\"'")
    return DataPaths(**{k: found[k] for k in DataPaths.__dataclass_fields__})
