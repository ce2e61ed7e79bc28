"""Named queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is its counterpart over the same tables, where there is one."""

    def keep(run: Query) -> Query:
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql.strip()
        return run

    return keep


def load_all() -> None:
    from docengine.plans import queries_items, queries_logs, queries_pages, queries_text  # noqa: F401
