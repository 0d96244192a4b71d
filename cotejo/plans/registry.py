"""The queries of the library and their DuckDB twins, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import content_queries, dedup_queries, resolve_queries, search_queries, text_queries

FLAGSHIP = "dedup_top5"
_MODULES = (text_queries, dedup_queries, resolve_queries, search_queries, content_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: q for m in _MODULES for name, q in m.ORACLE_SQL.items()}
