"""Query registry: a Spark callable and, where SQL can express it, the SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewater.sources.tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    """A named common table expression the reference SQL may use."""
    VIEWS[name] = sql.strip()


def _uses(sql: str) -> list[str]:
    words = set(re.findall(r"(?:from|join)\s+([a-z_0-9]+)", sql, re.IGNORECASE))
    return [v for v in VIEWS if v in words]


def _decimal_halves(sql: str) -> str:
    """Two-step roundings go away from zero on decimal halves, as in Spark."""
    return re.sub(r",9\),(\d)\)", r",9)*(1+1e-12),\1)", sql)


def with_views(sql: str) -> str:
    return _decimal_halves(_assemble(sql))


def _assemble(sql: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dep in _uses(VIEWS[name]):
            if dep != name:
                visit(dep)
        order.append(name)

    for v in _uses(sql):
        visit(v)
    if not order:
        return sql
    head = ",\n".join(f"{v} AS MATERIALIZED ({VIEWS[v]})" for v in order)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def oracle_sql() -> dict[str, str]:
    return {k: with_views(v) for k, v in ORACLES.items()}
