"""Thresholds and sizes, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # Sizes in characters, thresholds and prices that results depend on.
    max_papers: int = 5
    min_section: int = 200
    max_chunk: int = 512
    overlap: int = 50
    min_chunk: int = 100
    min_idea: int = 50
    low_overlap: float = 0.7
    medium_overlap: float = 0.4
    high_score: int = 70
    medium_score: int = 40
    top_k: int = 5
    min_similarity: float = 0.3
    snippet: int = 500
    input_price: float = 0.075
    output_price: float = 0.30
    keyword_cost: float = 0.001


DEFAULT = Settings()
