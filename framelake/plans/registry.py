"""Names of queries, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, with_: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name; `with_` holds the SQL's common tables."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = (f"WITH {with_} " if with_ else "") + " ".join(sql.split())
        return f

    return keep
