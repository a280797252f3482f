"""All queries of the catalogue operators."""

from __future__ import annotations

from tessera.plans import aggregate_queries, change_queries, join_queries, layout_queries, reader_queries, record_queries, sequence_queries, text_queries
from tessera.plans.aggregate_queries import type_tree  # noqa: F401

_MODULES = (text_queries, join_queries, aggregate_queries, change_queries, sequence_queries, record_queries, layout_queries, reader_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
