"""Scopes of memory: `global`, `session:x`, `user:x`, `type:x`, several joined by commas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = {"session": "session", "user": "user_id", "type": "block_type"}


def parse(scopes: str) -> list[tuple[str, str]]:
    """(kind, value) of each scope; an unknown kind or a missing value is an error."""
    out = []
    for scope in filter(None, (x.strip() for x in scopes.split(","))):
        kind, _, value = scope.partition(":")
        if kind == "global":
            continue
        if kind not in KINDS or not value:
            raise ValueError(f"unknown scope: {scope}")
        out.append((kind, value))
    return out


def within(scopes: str) -> Column:
    """Rows in all of the scopes; `global` holds everything."""
    out = F.lit(True)
    for kind, value in parse(scopes):
        out &= F.col(KINDS[kind]).cast("string") == value
    return out
