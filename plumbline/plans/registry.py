"""Registered queries and the SQL giving the same result on the same tables."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_MODULES = ["label_queries", "metric_queries", "grid_queries", "table_queries", "risk_queries", "text_queries", "derive_queries", "job_queries"]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with its SQL when the result can be written in SQL."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def load() -> None:
    for name in _MODULES:
        import_module(f"plumbline.plans.{name}")


def rounded(column: str | Column, digits: int = 6, name: str | None = None) -> Column:
    """Results are rounded only here, where two engines are compared."""
    value = F.col(column) if isinstance(column, str) else column
    return F.round(value, digits).alias(name or column)


def day(column: str, name: str | None = None) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(name or column)
