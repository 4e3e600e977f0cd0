"""All queries of the journal engine by operator id, and SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.prelude import PRELUDE

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str | Callable[[], str]] = {}


def query(name: str, sql: str | Callable[[], str] | None = None):
    """Registers a query; sql may use the tables of ``sources.prelude``. A function is called when the SQL is asked for."""

    def wrap(f):
        if name in _queries:
            raise ValueError(f"{name} is registered twice")
        _queries[name] = f
        if sql is not None:
            _sql[name] = sql
        return f

    return wrap


def _load() -> None:
    from . import (  # noqa: F401
        aggregation_queries,
        composite_queries,
        extension_queries,
        graph_queries,
        join_queries,
        mutation_queries,
        packing_queries,
        predicate_queries,
        scalar_queries,
        scan_queries,
        streaming_queries,
        version_queries,
        window_queries,
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: PRELUDE + (sql if isinstance(sql, str) else sql()) for name, sql in _sql.items()}
