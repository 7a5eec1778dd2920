"""All registered queries of the library and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skein.plans import code, documents, facts, files, global_search, graphs, hybrid, incremental, ranking, records, rewritten, selection, splitting

Query = Callable[[SparkSession, str], DataFrame]
PARTS = (ranking, documents, graphs, facts, selection, code, records, incremental, splitting, global_search, rewritten, hybrid, files)


def queries() -> dict[str, Query]:
    return {name: query for part in PARTS for name, (query, _) in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, (_, sql) in part.QUERIES.items() if sql}
