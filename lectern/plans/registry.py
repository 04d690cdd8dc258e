"""Registered queries: name -> function of (spark, sf_dir), and DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.plans.fixtures import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None, *views: str):
    """Register a function of Views under its name. oracle: DuckDB SQL over the tables and the named views."""

    def add(f: Callable[[Views], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if oracle is not None:
            ORACLE_SQL[f.__name__] = with_views(oracle, *views)
        return f

    return add
