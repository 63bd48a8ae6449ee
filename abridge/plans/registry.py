"""Registry of named queries: ``name -> (fn(spark, sf_dir) -> DataFrame, oracle SQL | None)``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    operators: tuple[str, ...]


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None, operators: tuple[str, ...] = ()):
    """Register ``fn`` under ``name`` with its DuckDB oracle SQL (None: no oracle)."""
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, operators or (name,))
        return fn
    return deco
