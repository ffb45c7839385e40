"""The registry: query name to callable, and to the equivalent SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Callable], Query]:
    """Register ``fn(t)``, where ``t(table)`` reads a table of the folder at hand; other queries build on ``.plan``."""

    def register(fn: Callable) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        run.__name__, run.__doc__, run.plan = name, fn.__doc__, fn
        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return run

    return register


from strataloom.plans import graphs, lifecycle, records, relational, retrieval, windows  # noqa: E402, F401  they register themselves
