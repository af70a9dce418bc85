"""All queries of the engine and their SQL."""

from __future__ import annotations

from . import case_queries, file_queries, queries

QUERIES = queries.QUERIES | file_queries.QUERIES | case_queries.QUERIES
ORACLE = queries.ORACLE | file_queries.ORACLE | case_queries.ORACLE
