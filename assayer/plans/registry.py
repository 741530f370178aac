"""Collects the checked queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name; those without SQL are checked by tests on fixtures."""

    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None):
        def register(function: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} registered twice")
            self.queries[name] = function
            if sql is not None:
                self.sql[name] = sql
            return function

        return register


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Round float columns, as sums differ in their last digits by order."""
    return df.withColumns({c: F.round(F.col(c), d) for c, d in digits.items()})


def stamp(column: str | Column) -> Column:
    """A timestamp as text, the same in both engines."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


REGISTRY = Registry()
