"""The registry of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenrank.plans.fixtures import with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, views: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query under its name, with its SQL over views."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = f"{with_views(*views)}{', ' if sql.lstrip().startswith('--with') else ' '}{sql.replace('--with', '')}" if views else sql
        return f

    return add


def rounded(c: str | Column, name: str | None = None) -> Column:
    """A column rounded to six places, as the SQL does."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name or str(c))
