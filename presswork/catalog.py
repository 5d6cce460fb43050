"""All registered queries and their SQL oracles."""

from __future__ import annotations

from .plans import expr_queries, queries

QUERIES = expr_queries.Q | queries.Q
ORACLE_SQL = expr_queries.SQL | queries.SQL
