"""The registry of queries and of the SQL they are compared with."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trailhead.plans.sql_tables import CTES
from trailhead.sources.adapters import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def with_tables(sql: str) -> str:
    """sql preceded by the domain tables that it names, and those that these name."""
    need: list[str] = []

    def visit(text: str) -> None:
        for name, body in CTES.items():
            if name not in need and re.search(rf"\b{name}\b", text):
                visit(body)
                need.append(name)

    visit(sql)
    if not need:
        return sql
    head = ", ".join(f"{n} AS ({CTES[n]})" for n in need)
    m = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql)
    recursive = "RECURSIVE " if m and m[1] else ""
    return f"WITH {recursive}{head}, {sql[m.end():]}" if m else f"WITH {head} {sql}"


def query(name: str, sql: str | None = None):
    """Register a function of Tables under a name, with the SQL that gives its rows."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE[name] = with_tables(sql)
        return f

    return add
