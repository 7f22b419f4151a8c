"""Registered queries: a Spark callable and, where SQL can say it, an independent check in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .check_views import VIEWS

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: Run
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    """Register `run(spark, sf_dir)`; `sql` may use the check views by name."""
    def add(run: Run) -> Run:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, run, with_views(sql) if sql else None)
        return run
    return add


def with_views(sql: str) -> str:
    """Prefix the check views a statement uses, dependencies first."""
    used: list[str] = []

    def visit(text: str) -> None:
        for name, body in VIEWS.items():
            if name in text and name not in used:
                visit(body)
                if name not in used:
                    used.append(name)

    visit(sql)
    if not used:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in used)
    head, rest = sql.lstrip(), None
    for start in ("WITH RECURSIVE ", "WITH "):
        if head.startswith(start):
            rest = head[len(start):]
            return f"WITH RECURSIVE {ctes},\n{rest}"
    return f"WITH {ctes}\n{head}"
