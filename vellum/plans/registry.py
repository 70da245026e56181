"""How query modules register their queries with the SQL that gives the same rows."""

from __future__ import annotations


def registry():
    """``(queries, oracles, query)``: two dictionaries and a decorator that files a function under its name, with its SQL if it has some."""
    queries: dict = {}
    oracles: dict = {}

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return add

    return queries, oracles, query
