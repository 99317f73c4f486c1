"""All queries of the engine by name, with the SQL that must give the same rows."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}
FLAGSHIP = "hybrid_search_scored"


def query(name: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under `name`."""

    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return put
