"""Query catalog: name -> (DataFrame function, oracle SQL or None, inventory ids)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    inventory: tuple[str, ...]


QUERIES: dict[str, Query] = {}


def register(name: str, inventory: str, sql: str | None = None):
    """Decorator: adds a ``(spark, sf_dir) -> DataFrame`` function to the catalog."""

    def add(run):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, run, sql, tuple(inventory.split()))
        return run

    return add
