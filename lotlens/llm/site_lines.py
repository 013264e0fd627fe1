"""Line dedup by site-relative frequency; DataFrame functions only.

Pages are grouped by host; a line is boilerplate on a host if the share of the host's pages that contain
it exceeds ``ratio`` and it is on ``min_pages`` pages at least (2: a line of one page is no boilerplate). Lines are counted as hashes, with partial sums
before the shuffle, so a hot host or line is no hot task; pages of a hot host, or of none, are spread when they meet the lines of their host. A host has fewer than (its mean number of lines per
page) / ``ratio`` boilerplate lines; only these come back to its pages, as one array per host.

Defined results: a line is trimmed of white space (``SPACES``), empty lines go; a page counts once for a line it repeats, and all
copies of a boilerplate line go; a page without host (null or strange url) is left as it is; null html gives
an empty text; repeated rows are separate pages; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotlens.operators.relational import lookup_join
from lotlens.session import stored

RATIO = 0.1
MIN_PAGES = 2
HIDDEN = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
BREAKS = r"(?i)</?(?:p|div|ul|ol|li|br|hr|h[1-6]|table|tr|td|th|nav|header|footer|main|article|section|aside|title|head|body|html|form|pre|blockquote)\b[^>]*>"
TAGS = r"<[^>]*>"
#: White space that a line is trimmed of.
SPACES = " \t\r\x0b\x0c\u00a0"
#: Pages of a host above which its pages are spread and its lines are broadcast.
HOT = 100_000


def page_lines(html: Column) -> Column:
    """The visible lines of a page: block elements and line feeds end a line, other tags vanish."""
    text = F.coalesce(html, F.lit(""))
    for pattern, to in ((HIDDEN, " "), (BREAKS, "\n"), (TAGS, "")):
        text = F.regexp_replace(text, pattern, to)
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES))), lambda x: x != "")


def site_host(url: Column) -> Column:
    """Lower-case host of an http(s) url without port; null if there is none."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?i)^https?://([^/?#:]+)", 1))
    return F.when(host != "", host)


def drop_site_lines(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, host, n_lines, n_dropped and the text that stays, of pages with page_id, host, lines."""
    pages = stored(pages.select("page_id", "host", "lines"), "page_lines")
    sited = pages.filter(F.col("host").isNotNull())
    totals = sited.groupBy("host").agg(F.count("*").alias("host_pages"))
    hashes = F.array_distinct(F.transform("lines", lambda x: F.xxhash64(x)))
    counts = sited.select("host", F.explode(hashes).alias("line")).groupBy("host", "line").agg(F.count("*").alias("line_pages"))
    counts = counts.filter(F.col("line_pages") >= min_pages)
    common = counts.join(totals, "host").filter(F.col("line_pages") > F.col("host_pages") * F.lit(ratio))
    boilerplate = common.groupBy("host").agg(F.collect_list("line").alias("boilerplate"), F.max("host_pages").alias("host_pages"))
    joined = lookup_join(pages, boilerplate, ["host"], "host_pages", HOT)
    kept = F.when(F.col("boilerplate").isNull(), F.col("lines")).otherwise(
        F.filter("lines", lambda x: ~F.array_contains("boilerplate", F.xxhash64(x))))
    return joined.select("page_id", "host", F.size("lines").alias("n_lines"), "lines", kept.alias("kept")).select(
        "page_id", "host", F.col("n_lines").cast("long"), (F.col("n_lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.array_join("kept", "\n").alias("text"))


def html_pages(pages: DataFrame) -> DataFrame:
    """page_id, host and lines of raw pages (page_id, url, html)."""
    return pages.select(F.col("page_id"), site_host(F.col("url")).alias("host"), page_lines(F.col("html")).alias("lines"))
