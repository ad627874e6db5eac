"""Registers a query with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """The decorated function gets ``v(name)``, which loads a view or table."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(lambda n: views.view(spark, sf_dir, n))
        if sql is not None:
            SQL[name] = views.with_views(sql)
        return f

    return add
