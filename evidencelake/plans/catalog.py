"""Registered queries of the evidence engine and their DuckDB forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import evaluation_queries, retrieval_queries, search_queries, storage_queries, structure_queries

_MODULES = (structure_queries, search_queries, retrieval_queries, evaluation_queries, storage_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
