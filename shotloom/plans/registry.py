"""Registry of queries and of the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def typed(sql: str, bigint: str = "", double: str = "") -> str:
    """Give the named SQL columns the type of the Spark side (sums widen and literals are decimals in SQL)."""
    casts = [f"CAST({c} AS BIGINT) AS {c}" for c in bigint.split()] + [f"CAST({c} AS DOUBLE) AS {c}" for c in double.split()]
    return f"SELECT * REPLACE ({', '.join(casts)}) FROM ({sql})"


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add
