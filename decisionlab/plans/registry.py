"""Registered queries, each with the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from decisionlab.plans.oracle_views import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, views: str = "") -> Callable[[Query], Query]:
    """Register a query under its function name; `views` names the CTEs its SQL reads."""

    def add(fn: Query) -> Query:
        if fn.__name__ in QUERIES:
            raise ValueError(f"{fn.__name__} is registered twice")
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = with_views(views.split(), sql)
        return fn

    return add


def text(name: str, alias: str | None = None) -> Column:
    return F.col(name).cast("string").alias(alias or name)


def r6(name: str | Column, alias: str | None = None, places: int = 6) -> Column:
    col = F.col(name) if isinstance(name, str) else name
    return F.round(col.cast("double"), places).alias(alias or name)
