"""Settings of the command line: where the stores are and what is loaded by default."""

from __future__ import annotations

from dataclasses import dataclass, fields
from pathlib import Path


def read_settings(path: str | Path | None) -> dict[str, str]:
    """KEY=VALUE lines of a file; comments, blank and other lines are skipped, quotes around a value go. No file: nothing."""
    if path is None or not Path(path).exists():
        return {}
    lines = (line.strip() for line in Path(path).read_text(encoding="utf-8").splitlines())
    pairs = (line.split("=", 1) for line in lines if "=" in line and not line.startswith("#"))
    return {k.strip(): v.strip().strip("\"'") for k, v in pairs}


@dataclass(frozen=True)
class Settings:
    """Folders are URIs of any file system that Spark reaches; ``folders`` are parted by commas."""

    store: str = "quadrel-store"
    graph_store: str = "quadrel-graph"
    folders: str = "ontologies"

    @classmethod
    def load(cls, path: str | Path | None = None, **overrides: str | None) -> "Settings":
        """Defaults, then the file (STORE, GRAPH_STORE, FOLDERS), then overrides that are given."""
        held = read_settings(path)
        values = {f.name: held[f.name.upper()] for f in fields(cls) if f.name.upper() in held}
        return cls(**(values | {k: v for k, v in overrides.items() if v is not None}))
