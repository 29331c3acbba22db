"""Settings with their bounds; values that can't be read fall back to the default."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass


def clamped(value: object, default: int, low: int, high: int) -> int:
    try:
        return max(low, min(high, int(value)))  # type: ignore[call-overload]
    except (TypeError, ValueError):
        return default


@dataclass(frozen=True)
class Settings:
    #: Defaults and bounds of limits.
    row_limit: int = 200  # 1 to 500
    timeout_s: int = 30  # 1 to 120
    sample: int = 100  # 10 to 1000
    references: int = 1000
    ast_nodes: int = 5000
    ast_bytes: int = 1 << 20

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ, prefix: str = "GRAPHLOOM_") -> Settings:
        get = lambda name: env.get(prefix + name)
        return cls(
            clamped(get("ROW_LIMIT"), 200, 1, 500), clamped(get("TIMEOUT_S"), 30, 1, 120), clamped(get("SAMPLE"), 100, 10, 1000),
            clamped(get("REFERENCES"), 1000, 1, 1_000_000), clamped(get("AST_NODES"), 5000, 1, 10_000_000), clamped(get("AST_BYTES"), 1 << 20, 1, 1 << 30),
        )
