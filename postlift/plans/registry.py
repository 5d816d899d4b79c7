"""Named queries with, where SQL can say it, their oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; it runs with the settings its plan and oracle assume."""
    def register(build):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return build(prepare(spark), sf)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build
    return register
