"""Registry of named queries and their SQL counterparts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import FIXTURES, Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_fixtures(body: str) -> str:
    """Prefix ``body`` with the derived tables it names, in dependency order."""
    order: list[str] = []

    def need(text):
        for name in FIXTURES:
            if re.search(rf"\b{name}\b", text) and name not in order:
                need(FIXTURES[name])
                if name not in order:
                    order.append(name)

    need(body)
    ctes = [f"{n} AS ({FIXTURES[n]})" for n in order]
    body = body.strip()
    m = re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.I)
    if m:
        ctes.append(body[m.end():])
        return f"WITH {'RECURSIVE ' if m.group(1) else ''}" + ",\n".join(ctes)
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body


def query(name: str, sql: str | None = None):
    """Register ``fn(t)`` under ``name``; ``t`` gives the raw and derived tables."""

    def deco(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_fixtures(sql)
        return fn

    return deco
