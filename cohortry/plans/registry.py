"""Registered queries: a Spark callable and, where SQL can say it, the equal DuckDB text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
CTES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return add


def cte(name: str, body: str) -> None:
    CTES[name] = body


def _used(text: str) -> list[str]:
    return [n for n in CTES if re.search(rf"\b{n}\b", text)]


def expand(sql: str) -> str:
    """Put the common table expressions a query names (and theirs) in front of it."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in _used(CTES[name]):
            if dep != name:
                visit(dep)
        order.append(name)

    for n in _used(sql):
        visit(n)
    if not order:
        return sql
    head = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in order)
    body = sql.strip()
    if re.match(r"(?i)with\s+recursive\b", body):
        return f"WITH RECURSIVE {head},\n{re.sub(r'(?i)^with\s+recursive', '', body, count=1)}"
    if re.match(r"(?i)with\b", body):
        return f"WITH {head},\n{re.sub(r'(?i)^with', '', body, count=1)}"
    return f"WITH {head}\n{body}"


def oracle_sql() -> dict[str, str]:
    return {name: expand(sql) for name, sql in SQL.items()}
