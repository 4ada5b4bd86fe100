"""Registry of named queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from aetherlog.plans.derived import Tables, with_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, *needs: str, sql: str | None = None, gap_us: int = 86400 * 1000000):
    """Register ``fn(Tables) -> DataFrame`` under a name, with SQL over derived inputs."""

    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLE[name] = with_ctes(sql, *needs, gap_us=gap_us) if needs else sql
        return fn

    return add
