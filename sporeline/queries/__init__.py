"""Queries that apply the operators to whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

from sporeline.queries import graph_queries, process_queries, series_queries

_MODULES = (graph_queries, process_queries, series_queries)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
