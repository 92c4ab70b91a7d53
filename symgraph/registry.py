"""The queries that modules of this package register, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_found: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        register(f.__name__, f, sql)
        return f

    return add


def register(name: str, f: Query, sql: str | None) -> None:
    _found[name] = (f, sql)


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _found.items() if sql}
