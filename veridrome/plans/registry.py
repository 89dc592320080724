"""Registration of queries with their SQL."""

from __future__ import annotations


def registry():
    """A decorator that registers a query under its name, and the two tables it fills."""
    queries, sql = {}, {}

    def query(text: str | None = None):
        def put(f):
            queries[f.__name__] = f
            if text:
                sql[f.__name__] = text
            return f

        return put

    return query, queries, sql
