"""Archive of fetched pages and the crawl log.

One crawl writes its pages once, below its run and source. Pages that no parser can use go to the quarantine side of the same write, with the
reason, so no fetched row is lost. Counters observed in that write become the rows of the crawl log; only the number of listings, which
needs distinct ids, is taken from the narrow id column of what was written. A reader names the runs it wants by rows of the log, and partition
pruning at run time skips the files of all other runs and sources.

A run that is written again replaces its own files and its rows of the log. Pages without a known source are quarantined.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from lotlens.functions.text import blank_safe, computed_once
from lotlens.operators.relational import checked_broadcast
from lotlens.schemas import TABLES
from lotlens.sources.tables import conform

ARCHIVE = f"{TABLES['pages']}, listing STRING, fault STRING, quarantined BOOLEAN, run STRING"
LOG = f"{TABLES['crawl_runs']}, run STRING"
NO_SOURCE = "none"


def page_fault(sources: Sequence[str]) -> Column:
    """Why a page can't be used: no known source, no address, no text, or cut before its end; null for a usable page."""
    html = blank_safe(F.col("html"))
    return (
        F.when(~F.coalesce(F.col("source").isin(*sources), F.lit(False)), "no_source")
        .when(F.trim(blank_safe(F.col("url"))) == "", "no_url").when(F.trim(html) == "", "no_page")
        .when(~html.rlike(r"(?i)</html\s*>\s*$"), "cut")
    )


def run_name(started_at: datetime) -> str:
    return started_at.strftime("%Y%m%dT%H%M%S")


def archive_crawl(root: str, pages: DataFrame, started_at: datetime, sources: Sequence[str], listing: Column | None = None) -> DataFrame:
    """Writes the pages of one crawl and its rows of the crawl log, one per source; returns the log rows.

    ``sources`` are the portals crawled (a fixed short list); ``listing`` is the listing a page shows, null for none. A source without a usable
    page has status ``error``. A write that fails leaves ``error`` rows with its message and raises.
    """
    spark, run = pages.sparkSession, run_name(started_at)
    rows = conform(pages.withColumn("_listing", F.lit(None).cast("string") if listing is None else listing), "pages", "_listing")
    rows = computed_once(rows.withColumn("fault", page_fault(sources)), "fault").withColumn("quarantined", F.col("fault").isNotNull())
    counters, seen = [], Observation(f"crawl-{run}")
    for i, source in enumerate(sources):
        mine = F.coalesce(F.col("source") == source, F.lit(False))
        counters += [F.count_if(mine).alias(f"pages_{i}"), F.max(F.when(mine, F.col("fetched_at"))).alias(f"last_{i}")]
        counters += [F.count_if(mine & F.coalesce(F.col("fault") == f, F.lit(False))).alias(f"{f}_{i}") for f in ("no_url", "no_page", "cut")]
    folder = f"{root}/pages/run={run}"
    rows = rows.withColumnRenamed("_listing", "listing").observe(seen, *counters).withColumn("source", F.coalesce("source", F.lit(NO_SOURCE)))
    try:
        rows.write.mode("overwrite").partitionBy("quarantined", "source").parquet(folder)
    except Exception as failure:
        _log(spark, root, run, [(s, started_at, None, "error", None, None, str(failure)) for s in sources])
        raise
    counts = seen.get
    shown = _archive(spark, root).where((F.col("run") == run) & ~F.col("quarantined") & F.col("listing").isNotNull())
    listings = {r.source: r.n for r in shown.select("source", "listing").distinct().groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = []
    for i, source in enumerate(sources):
        bad = {f: counts[f"{f}_{i}"] for f in ("no_url", "no_page", "cut") if counts[f"{f}_{i}"]}
        total = counts[f"pages_{i}"]
        error = ", ".join(f"{f} {n}" for f, n in bad.items()) or None
        status = "ok" if total > sum(bad.values()) else "error"
        out.append((source, started_at, counts[f"last_{i}"], status, total, listings.get(source, 0), error if total else "no pages"))
    return _log(spark, root, run, out)


def _log(spark: SparkSession, root: str, run: str, rows: list[tuple]) -> DataFrame:
    log = spark.createDataFrame(rows, TABLES["crawl_runs"])
    log.coalesce(1).write.mode("overwrite").parquet(f"{root}/crawl_runs/run={run}")
    return log


def _archive(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(ARCHIVE).parquet(f"{root}/pages")


def crawl_runs(spark: SparkSession, root: str) -> DataFrame:
    """The crawl log: one row per run and source."""
    return spark.read.schema(LOG).parquet(f"{root}/crawl_runs")


def recent_runs(runs: DataFrame, limit: int = 20) -> DataFrame:
    """The newest rows of the crawl log; ties by source."""
    return runs.orderBy(F.col("started_at").desc(), "source").limit(limit)


def read_pages(spark: SparkSession, root: str, runs: DataFrame | None = None) -> DataFrame:
    """Usable pages, of all runs or of the given rows of the crawl log; files of other runs and sources are pruned while the log is small enough to broadcast."""
    pages = _archive(spark, root).where(~F.col("quarantined")).drop("quarantined", "fault")
    if runs is None:
        return pages
    wanted = checked_broadcast(runs.select(F.col("run").alias("_run"), F.col("source").alias("_source")))
    return pages.join(wanted, (F.col("run") == F.col("_run")) & (F.col("source") == F.col("_source")), "left_semi")


def quarantined_pages(spark: SparkSession, root: str) -> DataFrame:
    """Pages set aside, with the reason in ``fault``."""
    return _archive(spark, root).where(F.col("quarantined")).withColumn(
        "source", F.when(F.col("source") != NO_SOURCE, F.col("source"))).drop("quarantined", "listing")
