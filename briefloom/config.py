"""Limits and weights of the engine. Time is a parameter: no operator reads the clock."""

from __future__ import annotations

from dataclasses import dataclass, field

HOUR_MS, DAY_MS = 3_600_000, 86_400_000


@dataclass(frozen=True)
class Quotas:
    """At most so many selected items in all, by kind and by source; ``reserve`` places are kept from P0 items."""

    total: int = 30
    papers: int = 4
    videos: int = 4
    podcasts: int = 2
    repos: int = 5
    arxiv: int = 10
    per_source: int = 4
    reserve: int = 8
    least_videos: int = 1


@dataclass(frozen=True)
class EngineConfig:
    now_ms: int
    quotas: Quotas = field(default_factory=Quotas)
    kept_per_feed: int = 80
    least_chars: int = 100
    most_body_chars: int = 15_000
    default_hours: int = 168
    future_ms: int = 2 * DAY_MS
    same_event: float = 0.85
    #: Words that make an item relevant where a source names none (fixed values).
    keyword_regex: str = "(ai|artificial intelligence|llm|agent|model|gpt|claude|gemini|inference|rag|deepseek|llama|nvidia|reasoning)"
