"""All queries of the engine by name, with the SQL that checks them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
MODULES = ("relational", "analytics", "dataset", "text", "scoring", "evaluation", "state", "streams", "values", "records", "resumes", "matching", "gold", "validation")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query (spark, sf_dir) -> DataFrame, and its equivalent SQL where there is one."""

    def register(function: Query) -> Query:
        if name in _QUERIES and _QUERIES[name].__qualname__ != function.__qualname__:
            raise ValueError(f"two queries are named {name}")
        _QUERIES[name] = function
        if sql is not None:
            _SQL[name] = sql
        return function

    return register


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"harrow.plans.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
