"""Settings of a memory store, and two presets."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    # fixed values: names and defaults
    fresh_tail: int = 64
    leaf_chunk_tokens: int = 20_000
    leaf_min_fanout: int = 8
    condensed_min_fanout: int = 4
    condensed_hard_fanout: int = 2
    leaf_target_tokens: int = 2400
    condensed_target_tokens: int = 2000
    max_context_tokens: int = 120_000
    hard_cap_tokens: int | None = None
    summary_ratio: float = 0.4
    soft_ratio: float = 0.75
    hard_ratio: float = 0.85
    cross_session_min_score: float = 0.70
    cross_session_tokens: int = 2000
    large_content_tokens: int = 25_000

    @property
    def effective_max_tokens(self) -> int:
        return self.max_context_tokens if self.hard_cap_tokens is None else min(self.max_context_tokens, self.hard_cap_tokens)

    def validated(self) -> Settings:
        if not 0 < self.soft_ratio <= self.hard_ratio:
            raise ValueError("soft_ratio must be positive and at most hard_ratio")
        if min(self.fresh_tail, self.leaf_min_fanout, self.condensed_min_fanout, self.leaf_chunk_tokens) < 1:
            raise ValueError("counts and limits must be positive")
        return self


ENGINE = Settings(fresh_tail=8, leaf_min_fanout=4, condensed_min_fanout=3, leaf_target_tokens=1200)
#: Small limits, so that the short conversations of the test tables are compacted at all.
SMALL = Settings(fresh_tail=2, leaf_chunk_tokens=300, leaf_min_fanout=2, condensed_min_fanout=2, leaf_target_tokens=100, condensed_target_tokens=100)


def from_env(base: Settings = Settings(), prefix: str = "THREADLOOM_", env: dict | None = None) -> Settings:
    """``base`` with the values that the environment names, such as THREADLOOM_FRESH_TAIL=8."""
    env = os.environ if env is None else env
    found = {}
    for f in fields(base):
        if (raw := env.get(prefix + f.name.upper())) not in (None, ""):
            found[f.name] = float(raw) if "float" in str(f.type) else int(raw)
    return replace(base, **found).validated()
