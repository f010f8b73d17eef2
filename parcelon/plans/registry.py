"""All queries of the engine by name, with the SQL that DuckDB runs beside them."""

from __future__ import annotations

from . import build_queries, geometry_queries, relation_queries, ring_queries, rule_queries, version_queries

QUERIES: dict = {**rule_queries.QUERIES, **geometry_queries.QUERIES, **version_queries.QUERIES, **relation_queries.QUERIES, **ring_queries.QUERIES, **build_queries.QUERIES}
SQL: dict = {**rule_queries.SQL, **geometry_queries.SQL, **version_queries.SQL, **relation_queries.SQL, **ring_queries.SQL, **build_queries.SQL}
