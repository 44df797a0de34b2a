"""Registry of queries: name, callable, SQL counterpart, and the inventory lines a query covers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    covers: str
    sql: str | None


CATALOG: dict[str, Entry] = {}


def query(covers: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name."""
    def add(fn: Query) -> Query:
        if fn.__name__ in CATALOG:
            raise ValueError(f"query {fn.__name__} is registered twice")
        CATALOG[fn.__name__] = Entry(fn, covers, sql)
        return fn
    return add
