"""A decorator that registers queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict, dict, Callable]:
    queries: dict[str, Callable] = {}
    sql: dict[str, str] = {}

    def query(statement: str | None = None):
        def register(f):
            queries[f.__name__] = f
            if statement:
                sql[f.__name__] = statement
            return f

        return register

    return queries, sql, query
