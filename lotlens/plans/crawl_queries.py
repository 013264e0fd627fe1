"""Page archive and crawl log: the pages table as four crawls of three portals."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lotlens.plans.registry import big, query, stamp
from lotlens.plans.views import table
from lotlens.session import scratch
from lotlens.sources import archive as A

FIRST = datetime(2024, 1, 1)
CRAWLS = 4
SOURCES = ("com", "net", "org")
# A page in 29 comes from no known portal, one in 31 is empty; the last crawl of one portal broke off inside every page.
VIEW = f"""pv AS (SELECT page_id, page_id % {CRAWLS} AS crawl, url,
    CASE WHEN page_id % 29 <> 0 THEN regexp_extract(url, 'example[.]([a-z]+)', 1) END AS source,
    TIMESTAMP '2024-01-01' + to_days(CAST(page_id % {CRAWLS} AS INTEGER)) AS started_at,
    TIMESTAMP '2024-01-01' + to_days(CAST(page_id % {CRAWLS} AS INTEGER)) + to_seconds(page_id) AS fetched_at,
    CASE WHEN page_id % 31 = 0 THEN '' WHEN page_id % {CRAWLS} = 3 AND url LIKE '%example.org/%' THEN left(html, 400) ELSE html END AS html,
    CASE WHEN url NOT LIKE '%page=%' THEN regexp_replace(url, '[?#].*$', '') END AS listing FROM pages),
ar AS (SELECT *, CASE WHEN source IS NULL OR source NOT IN ('com', 'net', 'org') THEN 'no_source' WHEN trim(html) = '' THEN 'no_page'
    WHEN NOT regexp_matches(html, '(?i)</html\\s*>\\s*$') THEN 'cut' END AS fault FROM pv),
runs AS (SELECT s.source, c.crawl, any_value(c.started_at) AS started_at, max(fetched_at) AS finished_at, CASE WHEN count(ar.page_id) FILTER (fault IS NULL) > 0 THEN 'ok' ELSE 'error' END AS status,
    count(ar.page_id) AS pages_fetched, count(DISTINCT listing) FILTER (fault IS NULL) AS listings_seen, count(*) FILTER (fault = 'no_page') AS np, count(*) FILTER (fault = 'cut') AS nc
  FROM (SELECT unnest(['com', 'net', 'org']) AS source) s CROSS JOIN (SELECT DISTINCT crawl, started_at FROM pv) c
  LEFT JOIN ar ON ar.source = s.source AND ar.crawl = c.crawl GROUP BY s.source, c.crawl),
log AS (SELECT *, CASE WHEN pages_fetched = 0 THEN 'no pages' WHEN np + nc > 0 THEN concat_ws(', ', CASE WHEN np > 0 THEN 'no_page ' || np END, CASE WHEN nc > 0 THEN 'cut ' || nc END) END AS error FROM runs)"""


def _crawled(spark, root) -> str:
    """Archives all crawls; returns the archive's root."""
    folder, k, url = scratch(spark, "archive"), F.col("page_id"), F.col("url")
    crawl = (k % CRAWLS).cast("int")
    pages = table(spark, root, "pages").select(
        crawl.alias("crawl"), url,
        F.when(k % 29 != 0, F.regexp_extract(url, "example[.]([a-z]+)", 1)).alias("source"),
        F.when(url.contains("page="), "list").otherwise("detail").alias("kind"),
        F.regexp_extract(url, "page=([0-9]+)", 1).try_cast("int").alias("page_no"),
        F.timestamp_add("SECOND", k.cast("int"), F.timestamp_add("DAY", crawl, F.lit(FIRST.isoformat()).cast("timestamp"))).alias("fetched_at"),
        F.when(k % 31 == 0, "").when((k % CRAWLS == 3) & url.contains("example.org/"), F.left("html", F.lit(400))).otherwise(F.col("html")).alias("html"),
    )
    listing = F.when(F.col("kind") == "detail", F.regexp_replace("url", "[?#].*$", ""))
    for number in range(CRAWLS):
        A.archive_crawl(folder, pages.where(F.col("crawl") == number), FIRST + timedelta(days=number), SOURCES, listing)
    return folder


def _shown(runs):
    return runs.select("source", stamp("started_at"), stamp("finished_at"), "status", *big("pages_fetched", "listings_seen"), "error")


LOG_COLUMNS = """source, strftime(started_at, '%Y-%m-%d %H:%M:%S') AS started_at, strftime(finished_at, '%Y-%m-%d %H:%M:%S') AS finished_at,
  status, pages_fetched, listings_seen, error"""


@query("crawl_runs_logged", f"WITH {VIEW}\nSELECT {LOG_COLUMNS} FROM log")
def crawl_runs_logged(spark, root):
    return _shown(A.crawl_runs(spark, _crawled(spark, root)))


@query("recent_crawl_runs", f"WITH {VIEW}\nSELECT {LOG_COLUMNS} FROM log ORDER BY log.started_at DESC, source LIMIT 5")
def recent_crawl_runs(spark, root):
    return _shown(A.recent_runs(A.crawl_runs(spark, _crawled(spark, root)), 5))


# Pages of runs that went well since the third day.
@query("pages_of_good_runs", f"""WITH {VIEW}
SELECT source, url, strftime(fetched_at, '%Y-%m-%d %H:%M:%S') AS fetched_at, length(html) AS size FROM ar JOIN log USING (source, crawl)
WHERE fault IS NULL AND status = 'ok' AND log.started_at >= TIMESTAMP '2024-01-03'""")
def pages_of_good_runs(spark, root):
    folder = _crawled(spark, root)
    runs = A.crawl_runs(spark, folder).where((F.col("status") == "ok") & (F.col("started_at") >= F.lit("2024-01-03").cast("timestamp")))
    return A.read_pages(spark, folder, runs).select("source", "url", stamp("fetched_at"), F.length("html").cast("bigint").alias("size"))


@query("pages_quarantined", f"WITH {VIEW}\nSELECT source, crawl, fault, count(*) AS n FROM ar WHERE fault IS NOT NULL GROUP BY ALL")
def pages_quarantined(spark, root):
    rows = A.quarantined_pages(spark, _crawled(spark, root))
    crawl = F.datediff(F.to_date("run", "yyyyMMdd'T'HHmmss"), F.lit(FIRST.date())).cast("bigint")
    return rows.groupBy("source", crawl.alias("crawl"), "fault").agg(F.count(F.lit(1)).alias("n"))
