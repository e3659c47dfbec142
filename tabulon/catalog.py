"""Registry of queries over the driver tables: name -> callable, and name -> DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: registers a query under name, with its oracle where there is one."""

    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return keep


def load() -> None:
    """Imports the modules that register queries."""
    import importlib

    for name in ("elementwise", "aggregates", "tables", "learning", "iterative", "tensors"):
        importlib.import_module(f"tabulon.queries.{name}")


load()
