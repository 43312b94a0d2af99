"""Settings of a memory engine."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Config:
    """Defaults as documented; :meth:`of` merges a user's settings over them, one level deep."""

    enabled: bool = True
    storage_root: str = ""
    top_k: int = 6
    min_similarity: float = 0.24
    capture_mode: str = "llm"
    capture_token_threshold: int = 6000
    max_span_chars: int = 24000
    max_items: int = 100_000
    dedupe_similarity: float = 0.87
    half_life_hours: float = 168.0
    embed_dim: int = 512
    extract_max_tokens: int = 2048
    recall_order: int = 140

    @classmethod
    def of(cls, settings: dict | None = None) -> Config:
        """Unknown settings are refused."""
        known = {f.name for f in fields(cls)}
        if extra := set(settings or {}) - known:
            raise ValueError(f"unknown settings: {sorted(extra)}")
        return replace(cls(), **(settings or {}))

    @property
    def candidates(self) -> int:
        """Width of the first cut of a recall."""
        return max(self.top_k * 4, 32)
