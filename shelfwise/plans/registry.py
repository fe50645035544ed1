"""Registered queries and the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfwise.plans.oracle_views import VIEWS
from shelfwise.plans.world import World

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _with_views(sql: str) -> str:
    """Prefix ``sql`` with the common table expressions it names, directly or through others."""
    needed: set[str] = set()
    pending = [sql]
    while pending:
        words = set(re.findall(r"\b[a-z_0-9]+\b", pending.pop()))
        for name in words & VIEWS.keys() - needed:
            needed.add(name)
            pending.append(VIEWS[name])
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in VIEWS if n in needed)
    return f"WITH {ctes}\n{sql}" if ctes else sql


def query(key: str, sql: str | None = None):
    """Register a function of a :class:`World` under ``key``; ``sql`` is its DuckDB equivalent."""
    def wrap(build: Callable[[World], DataFrame]):
        QUERIES[key] = lambda spark, sf_dir: build(World.of(spark, sf_dir))
        if sql is not None:
            ORACLE[key] = _with_views(sql)
        return build
    return wrap
