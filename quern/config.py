"""Settings of the retrieval engine; every default is a documented value of the modelled service."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    window_words: int = 1000
    overlap_ratio: float = 0.15
    paragraph_target: int = 800
    min_chunk_words: int = 8
    min_articles: int = 3
    intro_words: int = 20
    table_words: int = 350
    candidate_k: int = 20
    top_k: int = 5
    rerank_threshold: float = 0.1
    max_variants: int = 3
    rrf_k: int = 2
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    dense_dim: int = 64
    max_question_chars: int = 1000
    context_chars: int = 2200
    history_turns: int = 6
    history_ttl_s: int = 3600
    cache_ttl_s: int = 900
    rate_limit: int = 20
    rate_limit_ip: int = 300
    rate_window_s: int = 60
    eval_pass_rate: float = 0.8


SETTINGS = Settings()
