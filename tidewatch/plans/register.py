"""Registers queries with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add


def rounded(c: str | Column, alias: str | None = None, digits: int = 6) -> Column:
    """A double cut to the digits that both engines agree on, whatever the order of their sums."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits).alias(alias or c)


#: Added before rounding means of short decimals, which can stand exactly between two roundings.
OFF_TIES = 1.7e-9


def off_ties(c: str, alias: str | None = None, digits: int = 6) -> Column:
    return F.round(F.col(c) + OFF_TIES, digits).alias(alias or c)
