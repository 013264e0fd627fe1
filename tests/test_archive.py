"""Page archive: quarantine, log rows, repeated and failed crawls, pruning by the log."""

import pathlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lotlens.session import scratch
from lotlens.sources import archive as A
from lotlens.sources.pages import read_html_files

GOOD = "<html><body>x</body></html>\n"
SCHEMA = "source STRING, url STRING, fetched_at TIMESTAMP, html STRING"
DAY1, DAY2 = datetime(2024, 5, 1, 8), datetime(2024, 5, 1, 20)


def at(minute):
    return datetime(2024, 5, 1, 9, minute)


def crawl(spark, root, rows, started, sources=("olx", "lun")):
    return A.archive_crawl(root, spark.createDataFrame(rows, SCHEMA), started, sources, F.regexp_extract("url", "([0-9]+)", 1))


def test_quarantine_and_log(spark):
    root = scratch(spark, "archive")
    rows = [
        ("olx", "u/1", at(1), GOOD), ("olx", "u/1", at(2), GOOD), ("olx", "u/2", at(3), "<html>" + "y" * 100_000), ("olx", None, at(4), GOOD),
        ("olx", "u/5", at(5), None), ("olx", "u/6", at(6), "  "), (None, "u/7", at(7), GOOD), ("other", "u/8", at(8), GOOD),
    ]
    log = {r.source: r for r in crawl(spark, root, rows, DAY1).collect()}
    assert (log["olx"].status, log["olx"].pages_fetched, log["olx"].listings_seen) == ("ok", 6, 1)
    assert log["olx"].error == "no_url 1, no_page 2, cut 1" and log["olx"].finished_at == at(6)
    assert (log["lun"].status, log["lun"].pages_fetched, log["lun"].listings_seen, log["lun"].error) == ("error", 0, 0, "no pages")
    assert A.read_pages(spark, root).count() == 2
    bad = [(r.source, r.fault) for r in A.quarantined_pages(spark, root).collect()]
    assert sorted(bad, key=repr) == sorted([("olx", "cut"), ("olx", "no_url"), ("olx", "no_page"), ("olx", "no_page"), (None, "no_source"), ("other", "no_source")], key=repr)

    crawl(spark, root, rows[:1], DAY1)  # the run is written again: its files and log rows are replaced
    assert A.read_pages(spark, root).count() == 1 and A.quarantined_pages(spark, root).count() == 0
    assert A.crawl_runs(spark, root).where("source = 'olx'").select("pages_fetched", "error").collect() == [(1, None)]


def test_only_files_of_the_wanted_runs_are_read(spark):
    root = scratch(spark, "archive")
    crawl(spark, root, [("olx", "u/1", at(1), GOOD), ("lun", "u/2", at(1), GOOD)], DAY1)
    crawl(spark, root, [("olx", "u/3", at(1), GOOD), ("lun", "u/4", at(1), "cut")], DAY2)
    runs = A.crawl_runs(spark, root)
    assert [(r.source, r.started_at) for r in A.recent_runs(runs, 3).collect()] == [("lun", DAY2), ("olx", DAY2), ("lun", DAY1)]
    wanted = A.read_pages(spark, root, runs.where((F.col("status") == "ok") & (F.col("source") == "olx")))
    assert {r.url for r in wanted.collect()} == {"u/1", "u/3"}
    assert "dynamicpruning" in wanted._jdf.queryExecution().executedPlan().toString()


def test_failed_crawl_is_logged(spark):
    root = scratch(spark, "archive")
    rows = spark.createDataFrame([("olx", "u/1", at(1), GOOD)], SCHEMA).withColumn("html", F.raise_error(F.lit("connection lost")).cast("string"))
    with pytest.raises(Exception, match="connection lost"):
        A.archive_crawl(root, rows, DAY1, ["olx"])
    row = A.crawl_runs(spark, root).first()
    assert row.status == "error" and "connection lost" in row.error and row.pages_fetched is None


def test_empty_crawl(spark):
    root = scratch(spark, "archive")
    assert [r.status for r in crawl(spark, root, [], DAY1).collect()] == ["error", "error"]
    assert A.read_pages(spark, root).count() == 0


def test_html_files(spark, tmp_path):
    for n in range(3):
        pathlib.Path(tmp_path, f"{n}.html").write_text(f"<html>\n{n}\n</html>")
    rows = read_html_files(spark, str(tmp_path)).collect()
    assert sorted(r.html for r in rows) == [f"<html>\n{n}\n</html>" for n in range(3)] and all(r.url.endswith(".html") for r in rows)
