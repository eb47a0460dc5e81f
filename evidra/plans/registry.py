"""Queries register under their function's name, with SQL where SQL can express them."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def registry():
    def query(sql: str | None = None):
        def register(f):
            QUERIES[f.__name__] = f
            if sql:
                ORACLE_SQL[f.__name__] = sql
            return f

        return register

    return query
