"""Where queries and their SQL are kept."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame, with SQL for the same rows where there is some."""

    def keep(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return keep
