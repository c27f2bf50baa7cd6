"""Settings of the engine, one frozen record."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    chunk_tokens: int = 512
    overlap_tokens: int = 64
    max_chunks_per_site: int = 0
    max_sites: int = 5
    max_pages: int = 12
    least_chars: int = 120
    top_k: int = 4
    min_score: float = 0.35
    relative_cutoff: float = 0.82
    max_tokens: int = 1100
    max_tokens_long: int = 1400
    min_term_ratio: float = 0.5
    dimensions: int = 128
    embed_tokens: int = 8000

    def page_limit(self, asked: int | None) -> int:
        """Pages to crawl: 1 to 30, the default without a number."""
        return min(30, max(1, asked)) if asked else self.max_pages
