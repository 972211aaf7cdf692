"""Queries over the test tables, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of tables (name -> DataFrame) as a query."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        run.__doc__ = f.__doc__
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return f

    return register


from loomset.queries import dialogue, evaluation, pool, relational, text  # noqa: E402,F401
