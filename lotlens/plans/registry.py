"""Registry of runnable queries and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query; ``sql`` is the equivalent statement over the same tables."""
    def keep(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, root: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, root)

        QUERIES[name] = run
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return keep


def stamp(name: str):
    """A timestamp as text, for results that are compared across engines."""
    return F.date_format(F.col(name), "yyyy-MM-dd HH:mm:ss").alias(name)


def big(*names: str):
    return [F.col(n).cast("bigint").alias(n) for n in names]


def rounded(digits: int, *names: str):
    return [F.round(F.col(n), digits).alias(n) for n in names]
