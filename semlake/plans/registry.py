"""The engine's query registry: name -> Spark query and the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from semlake.fixtures import duckdb

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "e19_hybrid_pipeline"
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register the decorated function under its name, with its oracle SQL if there is one."""

    def add(f: Query) -> Query:
        if f.__name__ in _queries:
            raise ValueError(f"{f.__name__} is registered twice")
        _queries[f.__name__] = f
        if sql:
            _oracles[f.__name__] = duckdb(sql)
        return f

    return add


def _load() -> None:
    from semlake.plans import corpus, exchange, graph, linking, operations, rendering, retrieval, streams, understanding  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return _queries


def oracles() -> dict[str, str]:
    _load()
    return _oracles
