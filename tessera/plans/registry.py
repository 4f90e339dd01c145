"""Registration of queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.fixtures import with_rasters

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *rasters: str) -> Callable[[Query], Query]:
    """Register a query; ``sql`` may use the named rasters as tables."""

    def register(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = f
        if sql:
            whole = with_rasters(sql, *rasters) if rasters else sql
            ORACLES[name] = whole.replace("WITH ", "WITH RECURSIVE ", 1) if "USING KEY" in sql or "FROM h WHERE" in sql else whole
        return f

    return register
