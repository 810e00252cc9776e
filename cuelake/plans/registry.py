"""Where the query modules register what they hold."""
from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str):
    """Register f(spark, sf_dir) as `name`, with DuckDB SQL over the named views."""

    def add(f):
        QUERIES[name] = f
        if sql:
            body = sql.strip()
            if views:
                recursive = body.upper().startswith("RECURSIVE ")
                body = body[10:] if recursive else body
                joined = ", ".join(views)
                body = f"WITH {'RECURSIVE ' if recursive else ''}{joined}" + (f", {body[5:]}" if body.upper().startswith("WITH ") else f" {body}")
            ORACLES[name] = body
        return f

    return add
