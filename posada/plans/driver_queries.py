"""Named queries over the driver's tables, with the same computation in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, tuple[Query, str | None]] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Adds a query under its survey key, with its oracle where SQL can express it."""

    def add(query: Query) -> Query:
        if name in _REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        _REGISTRY[name] = (query, sql)
        return query

    return add


def _load() -> None:
    from posada.plans import catalogue  # noqa: F401  registers on import


def queries() -> dict[str, Query]:
    _load()
    return {name: query for name, (query, _) in _REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: sql for name, (_, sql) in _REGISTRY.items() if sql}
