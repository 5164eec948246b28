"""Named queries of the library and their DuckDB twins: (spark, sf_dir) -> DataFrame, and SQL where SQL can express it."""

from __future__ import annotations

from evigrain.plans import audit_queries, compare_queries, deck_queries, evidence_queries, layout_queries, role_queries, source_queries, state_queries, text_queries, visual_queries

_MODULES = (evidence_queries, text_queries, source_queries, audit_queries, compare_queries, visual_queries, state_queries, deck_queries, role_queries, layout_queries)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
