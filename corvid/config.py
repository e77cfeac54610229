"""Defaults of search, chunking and graph building."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class SearchConfig:
    top_k: int = 10
    chunk_k: int = 3
    min_score: float = 0.01
    hybrid: bool = False
    hybrid_weight: float = 0.1
    expand: bool = False
    overfetch: int = 12
    score_mode: str = "cosine"


@dataclass(frozen=True)
class ChunkConfig:
    size: int = 500
    overlap: int = 50

    @property
    def overlap_units(self) -> int:
        """How many of the last sentences start the next chunk."""
        return min(max(1, self.overlap // 4), 20)


@dataclass(frozen=True)
class GraphConfig:
    semantic_threshold: float = 0.75
    resolution: float = 1.0
    hops: int = 2
    decay: float = 0.5
    min_shared: int = 3
    max_per_unit: int = 5


@dataclass(frozen=True)
class SessionConfig:
    messages: int = 20
    idle_hours: int = 6
    sessions: int = 2000


@dataclass(frozen=True)
class Features:
    """What a service offers."""

    search: bool = True
    ask: bool = True
    view: bool = True

    def require(self, name: str) -> None:
        if not getattr(self, name):
            raise PermissionError(f"{name} is switched off")


def layered(kind: type, file: str | None = None, env: Mapping[str, str] | None = None):
    """A config of the kind: its defaults, under the object named like it in a JSON file, under variables CORVID_<KIND>_<FIELD>. A value that does not parse leaves the layer below."""
    name = kind.__name__.removesuffix("Config").lower()
    found = {}
    if file and os.path.exists(file):
        with open(file, encoding="utf-8") as f:
            found.update(json.load(f).get(name, {}))
    env = os.environ if env is None else env
    found |= {f.name: v for f in fields(kind) if (v := env.get(f"CORVID_{name}_{f.name}".upper())) is not None}
    base, out = kind(), {}
    for f in fields(kind):
        if f.name in found:
            was, v = getattr(base, f.name), found[f.name]
            try:
                out[f.name] = str(v).lower() in ("1", "true", "yes", "on") if isinstance(was, bool) else type(was)(v)
            except (TypeError, ValueError):
                continue
    return kind(**out)
