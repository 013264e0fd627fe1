"""Mart tables: scans with fixed schemas, append, upsert-by-day and versioned writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotlens.schemas import TABLES


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")


def conform(df: DataFrame, name: str, *more: str) -> DataFrame:
    """Columns and types of a mart table; missing columns become null. ``more`` columns stay as they are."""
    target = df.sparkSession.createDataFrame([], TABLES[name]).schema
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in target
    ], *more)


def append(df: DataFrame, root: str, name: str, time: str) -> None:
    """Append to an event-like table, one folder per day."""
    (df.withColumn("day", F.to_date(time)).write.mode("append").partitionBy("day").parquet(f"{root}/{name}"))


def upsert_daily(df: DataFrame, root: str, name: str = "market_daily") -> None:
    """Replace the days present in ``df`` and leave all other days."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy("day").parquet(f"{root}/{name}"))


def read_daily(spark: SparkSession, root: str, name: str = "market_daily") -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")


def write_version(df: DataFrame, root: str, name: str, version: str) -> str:
    """Write a whole new version of a keyed table; readers switch to the returned path."""
    path = f"{root}/{name}/version={version}"
    df.write.mode("overwrite").parquet(path)
    return path


def log_run(
    spark: SparkSession, root: str, source: str, started_at, finished_at, status: str,
    pages_fetched: int | None = None, listings_seen: int | None = None, error: str | None = None,
) -> DataFrame:
    """One row of the crawl log, appended; returns it."""
    row = spark.createDataFrame(
        [(source, started_at, finished_at, status, pages_fetched, listings_seen, error)], TABLES["crawl_runs"]
    )
    append(row, root, "crawl_runs", "started_at")
    return row
