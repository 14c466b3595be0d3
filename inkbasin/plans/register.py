"""Registers a query with its SQL in a module's tables."""

from __future__ import annotations


def registry():
    queries: dict = {}
    oracles: dict[str, str] = {}

    def query(sql: str | None = None):
        def keep(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return keep

    return queries, oracles, query
