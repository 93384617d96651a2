"""Registering queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of (spark, sf_dir) under ``name``, with SQL for the same rows if it can be had."""

    def add(run: Callable) -> Callable:
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return add
