"""Registered queries: every operator over the given tables, with its SQL twin.

``QUERIES`` maps a name to a callable ``(spark, sf_dir) -> DataFrame``, ``ORACLES`` the
same name to SQL for another engine. Both see whole tables and whole texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load() -> None:
    """Import the modules that register queries."""
    from reposieve import queries_detect, queries_files, queries_reports, queries_scalars  # noqa: F401
