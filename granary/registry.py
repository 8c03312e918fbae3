"""All queries of the storage-analytics part, by the operator they exercise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under an operator's name, with its SQL where there is one."""

    def add(f: Query) -> Query:
        if name in _queries:
            raise ValueError(f"{name} is registered already")
        _queries[name] = f
        if sql is not None:
            _sql[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    import granary.plans  # noqa: F401  (its modules register their queries)

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    import granary.plans  # noqa: F401

    return dict(_sql)
