"""Registered queries and their oracle statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strainframe.catalog.views import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, extra: dict[str, str] | None = None):
    """Register a query; without ``sql`` only its rows can be checked."""

    def add(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = with_views(sql, extra)
        return build

    return add


def r6(column: Column | str) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    return F.round(value.cast("double"), 6)


def rounded(frame: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return frame.withColumns({name: F.round(F.col(name).cast("double"), digits) for name in names})
