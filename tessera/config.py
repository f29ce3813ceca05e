"""Engine settings with their defaults."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path


@dataclass(frozen=True)
class EngineConfig:
    """``limit`` <= 0 means unlimited; ``min_size`` is in bytes and holds for scans only;
    ``compact_percent``: share of holes from which the index is compacted."""

    name: str = "tessera"
    limit: int = 30
    exact: bool = False
    normalize_query: bool = True
    request_text: bool = False
    min_size: int = 10
    compact_percent: float = 5.0
    dirs: list[str] = field(default_factory=list)
    extensions: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)

    def problems(self) -> list[str]:
        """What keeps these settings from being usable."""
        return [f"{k} is missing" for k in ("name", "dirs", "extensions") if not getattr(self, k)]

    @classmethod
    def load(cls, path: str) -> EngineConfig:
        """Settings of a JSON file; defaults fill what it lacks, and the file is written back complete."""
        try:
            raw = json.loads(Path(path).read_text(encoding="utf-8"))
        except (OSError, ValueError):
            raw = {}
        known = {f.name for f in fields(cls)}
        out = cls(**{k: v for k, v in raw.items() if k in known})
        out.save(path)
        return out

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self), ensure_ascii=False, indent=2), encoding="utf-8")
