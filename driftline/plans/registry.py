"""Registry of bound queries and their oracle statements."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, str] = {}


def view(name: str, sql: str) -> None:
    """A named oracle relation; names start with ``v_``."""
    VIEWS[name] = sql.strip()


def with_views(sql: str) -> str:
    """Prepend the views a statement mentions, dependencies first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\bv_\w+", text)):
            if name in VIEWS and name not in order:
                visit(VIEWS[name])
                if name not in order:
                    order.append(name)

    visit(sql)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in order)
    body = sql.strip()
    body = f",{body[4:]}" if body.upper().startswith("WITH") else f"\n{body}"
    return f"WITH {ctes}{body}"


def query(key: str, sql: str | None = None):
    def register(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register


def oracle_statements() -> dict[str, str]:
    return {k: with_views(s) for k, s in ORACLES.items()}


def r(c: str | Column, digits: int = 6) -> Column:
    """Rounded double without a negative zero (for exact comparison)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    for n in names:
        df = df.withColumn(n, r(n, digits))
    return df


def R(expr: str, digits: int = 6) -> str:
    """The SQL counterpart of :func:`r`."""
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE))"


def sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"
