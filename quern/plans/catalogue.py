"""Queries of the retrieval operators, by name, and their SQL."""

from __future__ import annotations

from . import corpus, search, serving

FLAGSHIP = "bm25_topk"
QUERIES = corpus.QUERIES | search.QUERIES | serving.QUERIES
ORACLES = corpus.ORACLES | search.ORACLES | serving.ORACLES
