"""Query registry: one Spark callable and, where SQL can express it on whole tables, one oracle."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def with_ctes(*parts: str, select: str) -> str:
    """Assemble ``WITH a AS (...), b AS (...) SELECT`` from CTE snippets, dropping repeats."""
    seen: list[str] = []
    for p in parts:
        for piece in ([p] if isinstance(p, str) else p):
            if piece not in seen:
                seen.append(piece)
    return "WITH RECURSIVE " + ",\n".join(seen) + "\n" + select
