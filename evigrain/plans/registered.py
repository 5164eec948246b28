"""How query modules register their queries."""

from __future__ import annotations


def registry() -> tuple[dict, dict[str, str], object]:
    queries: dict = {}
    oracles: dict[str, str] = {}

    def query(name: str, sql: str | None = None):
        def keep(f):
            queries[name] = f
            if sql is not None:
                oracles[name] = sql
            return f

        return keep

    return queries, oracles, query
