"""The queries of the log-stream engine and their SQL, by name."""

from __future__ import annotations

from . import binary_queries, control_queries, format_queries, log_queries, state_queries

_PARTS = (log_queries, control_queries, state_queries, binary_queries, format_queries)
QUERIES: dict = {k: f for p in _PARTS for k, f in p.QUERIES.items()}
SQL: dict = {k: s for p in _PARTS for k, s in p.SQL.items()}
