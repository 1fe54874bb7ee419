"""Registry of the engine's queries and of the SQL that gives the same results."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Modules of evograph.operators, in the order of the survey; each has QUERIES and SQL.
MODULES: tuple[str, ...] = ("complexity", "graph", "history", "coupling", "trends", "search", "ingest", "watching")


def queries() -> dict[str, Query]:
    return {k: q for m in MODULES for k, q in import_module(f"evograph.operators.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in import_module(f"evograph.operators.{m}").SQL.items()}
