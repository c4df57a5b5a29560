"""Registered queries and the SQL each is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from .bindings import SQL_VIEWS, Views

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}
MODULE: dict[str, str] = {}


def with_views(sql: str) -> str:
    """Prefix the statement with the shared views it names, in definition order."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name, body in SQL_VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(body)

    visit(sql)
    parts = [f"{n} AS MATERIALIZED ({SQL_VIEWS[n]})" for n in SQL_VIEWS if n in needed]
    if not parts:
        return sql.strip()
    body = sql.strip()
    if re.match(r"(?i)with\s+recursive\b", body):
        return "WITH RECURSIVE " + ", ".join(parts) + ", " + body[len("WITH RECURSIVE"):]
    if re.match(r"(?i)with\b", body):
        return "WITH " + ", ".join(parts) + ", " + body[4:]
    return "WITH " + ", ".join(parts) + " " + body


def query(name: str, sql: str | None = None):
    """Register ``fn(views) -> DataFrame`` under ``name`` with its check SQL."""

    def wrap(fn):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, folder: fn(Views(spark, folder))
        MODULE[name] = fn.__module__.rsplit(".", 1)[-1]
        if sql is not None:
            ORACLE[name] = with_views(sql)
        return fn

    return wrap
