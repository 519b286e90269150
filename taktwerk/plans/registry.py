"""All queries of the transit engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from taktwerk.sources.fixtures import PRELUDE, Fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, prelude: bool = True, recursive: bool = False):
    """Registers a plan over the fixtures; ``sql`` follows the fixtures' common table expressions, which are ``recursive`` where it says so."""

    def add(plan: Callable[[Fixtures], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: plan(Fixtures(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = (PRELUDE + (sql if sql.lstrip().startswith(",") else " " + sql)) if prelude else sql
            if recursive:
                ORACLE_SQL[name] = ORACLE_SQL[name].replace("WITH", "WITH RECURSIVE", 1)
        return plan

    return add


from taktwerk.plans import delays, departures, dimension, discovery, jobs, live, operations, schedule, statistics, stops, streams, trips, upstream, vehicles  # noqa: E402, F401
