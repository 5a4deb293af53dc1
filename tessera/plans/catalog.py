"""All queries outside the optional subpackage, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import aggregates, changes, dialogues, documents, joins, scalars, shop, streams, times, user_functions, vectors, windows

MODULES = (joins, aggregates, windows, scalars, dialogues, documents, shop, changes, times, vectors, streams, user_functions)
FLAGSHIP = "conv_summary"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _m in MODULES:
    QUERIES |= _m.QUERIES
    ORACLE_SQL |= _m.ORACLE_SQL
