"""All registered queries of the evidence engine, with their SQL where SQL can express them."""

from __future__ import annotations

from . import queries_audit, queries_content, queries_names, queries_snapshots, queries_sources, queries_store, queries_surfaces

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _module in (queries_audit, queries_snapshots, queries_content, queries_names, queries_sources, queries_store, queries_surfaces):
    QUERIES |= _module.catalogue.queries
    ORACLE_SQL |= _module.catalogue.sql
