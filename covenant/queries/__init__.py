"""Named queries over the driver's tables, one or more for each operator.

A query is a function of a session and a folder; beside it stands the same in
plain SQL, where SQL can say it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL if there is any."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """All queries and their SQL."""
    from . import baseline, changes, contracts, engine, functions, profiles, relational, states, validation  # noqa: F401

    return dict(QUERIES), dict(ORACLES)
