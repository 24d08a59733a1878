"""Queries over the bundled tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return register


def load_all() -> None:
    """Import every query module once."""
    from importlib import import_module
    for m in ("sources", "proximity", "panel", "evaluation", "network", "context", "export", "models", "quality", "facilities"):
        import_module(f"junctura.catalog.q_{m}")
