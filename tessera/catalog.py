"""Registry of the engine's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "url_inventory"


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with the DuckDB statement for its rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


from tessera.plans import queries_builds, queries_graph, queries_layers, queries_more, queries_relational, queries_rules, queries_search, queries_text, queries_urls  # noqa: E402, F401
