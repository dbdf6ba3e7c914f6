"""Registry of named queries: a Spark builder and, where SQL can state it, the
equivalent DuckDB SQL over the same parquet tables (the oracle)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass
class Query:
    name: str
    fn: QueryFn
    sql: str | None


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, fn, sql)
        return fn

    return deco


def dcount(text_sql: str, needle: str) -> str:
    """DuckDB: non-overlapping occurrences of a literal."""
    lit = needle.replace("'", "''")
    return f"((strlen({text_sql}) - strlen(replace({text_sql}, '{lit}', ''))) // {len(needle.encode())})"


def load_all() -> dict[str, Query]:
    # importing the modules registers their queries
    from culler.plans import (  # noqa: F401
        q_extract,
        q_metrics,
        q_select,
        q_vectors,
        q_cluster,
        q_sinks,
    )

    return REGISTRY
