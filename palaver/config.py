"""Engine settings (S10): defaults, then a dict, then PALAVER_* variables, then a file's values."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields, replace

from palaver import schemas as S


@dataclass(frozen=True)
class Settings:
    total_budget: int = 0
    context_length: int = S.CONTEXT_LENGTH
    budget_percent: float = S.BUDGET_PERCENT
    state_ratio: float = S.STATE_RATIO
    retrieved_ratio: float = S.RETRIEVED_RATIO
    tail_ratio: float = S.TAIL_RATIO
    tail_floor: int = S.TAIL_FLOOR
    min_candidates: int = S.MIN_CANDIDATES
    top_k: int = 0
    decay: float = S.DECAY
    max_depth: int = S.MAX_DEPTH
    recency_lambda: float = S.RECENCY_LAMBDA
    reranker_enabled: bool = True
    enrichment_every: int = S.ENRICH_EVERY
    checkpoint_calls: int = S.CHECKPOINT_CALLS
    memory_tools: tuple[str, ...] = S.MEMORY_TOOLS
    memory_hint: bool = True
    goal_trail: int = S.GOAL_TRAIL
    drift_threshold: float = S.DRIFT_THRESHOLD
    #: 0: the mean of all vectors of the segment
    centroid_window: int = S.CENTROID_WINDOW
    summary_threshold: int = S.SUMMARY_THRESHOLD
    summary_tokens: int = S.SUMMARY_TOKENS
    overhead_start: int = S.OVERHEAD_START
    trace_bytes: int = 10 << 20
    trace_generations: int = 3
    embedding_endpoint: str = ""
    embedding_model: str = ""
    embedding_key: str = ""
    embedding_timeout: float = 60.0
    reranker_endpoint: str = ""
    reranker_model: str = "rerank"
    reranker_key: str = ""
    reranker_timeout: float = 10.0
    #: 0: all stay
    reranker_top_k: int = 0
    enrichment_enabled: bool = True
    enrichment_boundary: bool = True
    enrichment_turns: int = S.ENRICH_TURNS
    enricher_endpoint: str = ""
    enricher_model: str = ""
    enricher_key: str = ""
    enricher_timeout: float = 30.0
    enricher_tokens: int = 1500

    @property
    def budget(self) -> int:
        """B1: an absolute budget, or a share of the context length."""
        return self.total_budget if self.total_budget > 0 else int(self.context_length * self.budget_percent)


def coerce(raw, kind):
    if not isinstance(raw, str):
        return tuple(raw) if isinstance(kind, tuple) else raw
    if isinstance(kind, bool):
        return raw.strip().lower() in ("1", "true", "yes", "on")
    if isinstance(kind, tuple):
        return tuple(x.strip() for x in raw.split(",") if x.strip())
    return type(kind)(raw)


def load_settings(given: dict | None = None, env: dict | None = None, file_values: dict | None = None, prefix: str = "PALAVER_") -> Settings:
    base, env = Settings(), os.environ if env is None else env
    names = [f.name for f in fields(Settings)]
    layers = [given or {}, {n: env[prefix + n.upper()] for n in names if prefix + n.upper() in env}, file_values or {}]
    for layer in layers:
        known = {k: coerce(v, getattr(base, k)) for k, v in layer.items() if k in names}
        base = replace(base, **known)
    return base
