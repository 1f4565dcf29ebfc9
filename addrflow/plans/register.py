"""Where queries and their SQL twins are registered."""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import DataFrame, SparkSession

from .carriers import carrier, with_carriers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
AS_OF = "2024-02-01 00:00:00"


def query(name: str, *tables: str, sql: str | None = None, keep: Collection[str] = ()):
    """Register a function of the named tables as a query, and its oracle; the tables in ``keep`` are made once."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            made: dict[str, DataFrame] = {}
            return f(*(carrier(spark, sf_dir, t, keep, made) for t in tables))

        QUERIES[name] = run
        if sql:
            ORACLES[name] = with_carriers(sql, *tables)
        return f

    return register
