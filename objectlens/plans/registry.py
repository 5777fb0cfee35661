"""The registered queries, each beside its SQL twin for DuckDB where it has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from objectlens.session import table
from objectlens.sources.views import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    """Register a function of (view, tab), which give a view or a table by name."""

    def add(f):
        name = f.__name__

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda n: view(spark, sf_dir, n), lambda n: table(spark, sf_dir, n))

        QUERIES[name] = run
        if sql:
            SQL[name] = with_views(sql, *views) if views else sql
        return f

    return add


def rounded(c: Column, places: int = 6) -> Column:
    """c rounded as DuckDB rounds doubles: the scaled double to a whole number; Spark alone would round its decimal digits, which differs at ties."""
    return F.round(c.cast("double") * 10.0**places) / 10.0**places
