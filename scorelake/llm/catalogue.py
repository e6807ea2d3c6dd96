"""All queries for training data by name, and their SQL."""

from __future__ import annotations

from scorelake.llm import canonical_queries, container_queries, near_queries, overlap_queries, pair_queries, quota_queries, split_queries, token_queries

_MODULES = [near_queries, quota_queries, overlap_queries, pair_queries, split_queries, canonical_queries, token_queries, container_queries]
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _MODULES for k, s in m.ORACLES.items()}
