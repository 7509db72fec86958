"""All registered queries with their SQL."""

from __future__ import annotations

from . import capture_queries, host_queries, library_queries, pair_queries, plane_queries, quality_queries

_MODULES = (capture_queries, pair_queries, quality_queries, plane_queries, host_queries, library_queries)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _MODULES for k, s in m.ORACLES.items()}
