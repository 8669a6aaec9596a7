"""Register of runnable queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(tables) -> DataFrame`` under ``name``, with the SQL that must agree with it."""

    def add(build):
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            from sitegauge.plans.bindings import Tables

            return build(Tables(spark, sf_dir))

        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return build

    return add
