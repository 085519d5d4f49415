"""Named queries over a table folder, and the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: SQL that says the same but is too slow for more than the smallest tables, on which the tests hold queries against it.
SLOW_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None, slow: str | None = None):
    """Register a query ``(spark, sf_dir) -> DataFrame`` and its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        if slow:
            SLOW_SQL[name] = slow
        return f

    return add


def also(name: str, known: str) -> None:
    """A second name of a registered query."""
    QUERIES[name] = QUERIES[known]
    if known in ORACLES:
        ORACLES[name] = ORACLES[known]
