"""The registered queries and the SQL that each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a (spark, sf_dir) -> DataFrame function under `name`, with its SQL where SQL can express it."""

    def keep(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return keep


def oracle(name: str) -> str:
    """The SQL of a query that was registered before."""
    return _SQL[name]


def _load() -> None:
    from graphlens.plans import doc_queries, graph_queries, lookup_queries, snapshot_queries, state_queries, summary_queries  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
