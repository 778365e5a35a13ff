"""All queries of the library outside the training-data subpackage, and their SQL."""

from __future__ import annotations

from . import insight_queries, matching_queries, procurement_queries, text_queries

_MODULES = (procurement_queries, matching_queries, insight_queries, text_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
