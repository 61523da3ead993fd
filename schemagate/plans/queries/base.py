"""Registration of queries and what their SQL has in common."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from schemagate.functions.text import EDGE_WHITESPACE

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SQL_WHITESPACE = "||".join(f"chr({ord(ch)})" for ch in dict.fromkeys(EDGE_WHITESPACE))


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def sql_strip(expr: str) -> str:
    return f"trim({expr}, {SQL_WHITESPACE})"
