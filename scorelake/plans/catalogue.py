"""All core queries by name, and their SQL."""

from __future__ import annotations

from scorelake.plans import evaluation_queries, reference_queries, relational_queries, sql_queries

FLAGSHIP = "macro_average"
_MODULES = [reference_queries, evaluation_queries, relational_queries, sql_queries]
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _MODULES for k, s in m.ORACLES.items()}
