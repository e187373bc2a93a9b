"""Registry of the queries outside the llm subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query and, where SQL can express it, the SQL that gives the same rows."""

    def register(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLE_SQL[key] = sql
        return f

    return register


def _load() -> None:
    import importlib

    for name in ("corpus", "build", "models", "packing", "chat", "evals", "monitor", "streams"):
        importlib.import_module(f"millrace.plans.{name}")


_load()
