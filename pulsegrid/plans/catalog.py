"""The registry of named queries."""

from __future__ import annotations

from . import draw_queries, event_queries, long_queries, shape_queries, signal_queries, table_queries

MODULES = (event_queries, table_queries, signal_queries, shape_queries, draw_queries, long_queries)
QUERIES: dict = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for m in MODULES for k, v in m.ORACLES.items()}
