"""One query per operator over the supplied tables, with its SQL check."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

AREAS = ("metrics", "validation", "cleaning", "insights", "profiling", "schema", "text",
         "sources")


def query(name: str, sql: str | None = None):
    """Register a query under ``name``, with the SQL that must agree with it."""
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return register


def load() -> None:
    for area in AREAS:
        importlib.import_module(f"{__name__}.{area}")
