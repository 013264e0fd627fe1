"""Skew-safe building blocks and state rules against plain counterparts."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lotlens.config import MarketConfig
from lotlens.operators import deals as D
from lotlens.operators import market as M
from lotlens.operators import quality as Q
from lotlens.operators import search as X
from lotlens.operators import state as S
from lotlens.operators.changes import change_events, fold_observations, track_observations
from lotlens.operators.relational import exact_median, lookup_join, page, top_n_per_group
from lotlens.operators.timeline import Timeline
from lotlens.plans.views import listing_view, observation_view
from lotlens.schemas import EXTRA, TABLES
from lotlens.session import scratch
from lotlens.sources import tables as B

def now():
    return F.lit("2024-06-01 12:00:00").cast("timestamp")


def hours_ago(h):
    return dt.datetime(2024, 6, 1, 12) - dt.timedelta(hours=h)


def test_exact_median_with_a_hot_key(spark):
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string")).alias("k"),
        (F.xxhash64("id") % 10_007 / 7.0).alias("v"))
    got = exact_median(rows, ["k"], "v", accuracy=200)
    want = rows.groupBy("k").agg(F.median("v").alias("m"), F.count("v").alias("c"))
    joined = got.join(want, "k")
    assert joined.count() == want.count()
    assert joined.where((F.abs(F.col("median") - F.col("m")) > 1e-9) | (F.col("n") != F.col("c"))).count() == 0


def test_lookup_join_splits_hot_keys(spark):
    left = spark.range(5_000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 97).alias("k"))
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("k <> 5")
    want = left.join(right, "k", "left").select("id", "k", "n")
    for hot in (1, 100, 10**6):
        got = lookup_join(left, right, ["k"], "n", hot_rows=hot).select("id", "k", "n")
        assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_top_n_per_group(spark):
    rows = spark.range(4_000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7).alias("k"), (F.xxhash64("id") % 100).alias("v"))
    got = top_n_per_group(rows, ["k"], [F.col("v"), F.col("id")], 20, F.col("id"))
    w = Window.partitionBy("k").orderBy("v", "id")
    want = rows.withColumn("rank", F.row_number().over(w)).where("rank <= 20")
    assert got.select("id", "rank").exceptAll(want.select("id", "rank")).count() == 0 and got.count() == want.count()


def test_page_is_clamped(spark):
    rows = spark.range(55)
    assert [r.id for r in page(rows, [F.col("id")], 99, 50).collect()] == list(range(50, 55))
    assert page(rows, [F.col("id")], 0, 50).count() == 50


def test_tracking_is_the_same_with_hot_listings(spark, sf):
    obs = observation_view(spark, sf)
    plain = track_observations(obs, idle_hours=72, drop_counts=True)
    split = track_observations(obs, idle_hours=72, drop_counts=True, hot_rows=4)
    assert plain.exceptAll(split).count() == 0 and split.exceptAll(plain).count() == 0


def test_a_listing_with_a_third_of_the_log_on_one_day(spark):
    """Splits hold like numbers of rows, on one day and at one instant; a window's tasks stay even without adaptive execution."""
    n = 24_000
    hot = spark.range(n // 3).select(
        F.lit("hot").alias("k"), (F.lit(1_700_000_000) + F.when(F.col("id") < n // 6, 7).otherwise(F.col("id") % 80_000)).alias("t"), F.col("id").alias("seq"),
        F.when(F.xxhash64("id") % 3 == 0, F.xxhash64("id") % 50).alias("v"))
    rest = spark.range(2 * n // 3).select(
        (F.col("id") % 1500).cast("string").alias("k"), (F.lit(1_700_000_000) + F.col("id")).alias("t"), F.col("id").alias("seq"), F.when(F.col("id") % 2 == 0, F.col("id") % 9).alias("v"))
    rows = hot.unionByName(rest).unionByName(rest.where("k = '5'").withColumn("k", F.lit(None).cast("string"))).repartition(6)
    old = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        line = Timeline(rows, ["k"], ["t", "seq"], hot_rows=400)
        splits = [r["count"] for r in line.rows.where("k = 'hot'").groupBy("_bucket").count().collect()]
        assert len(splits) > 30 and max(splits) <= 3 * sorted(splits)[len(splits) // 2]
        got = line.previous(["v"]).running_count(F.col("v") > 5, "c").rows
        tasks = sorted(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect())
        assert tasks[-1] <= 3 * tasks[len(tasks) // 2]
        w = Window.partitionBy("k").orderBy("t", "seq")
        want = rows.withColumn("prev_v", F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
        want = want.withColumn("c", F.sum(F.coalesce((F.col("v") > 5).cast("long"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        got = got.select(want.columns)
        assert got.exceptAll(want).count() == 0 and got.count() == want.count()
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)


def test_fold_equals_repeated_merge(spark, sf):
    """The state folded from a log is the state merged card by card, crawl after crawl."""
    obs = observation_view(spark, sf).where("property_key in ('1', '2', '3')")
    state = spark.createDataFrame([], TABLES["listings"])
    place = F.row_number().over(Window.partitionBy("source", "external_id").orderBy("seen_at", "seq"))
    numbered = obs.withColumn("round", place)
    for i in range(1, 5):
        batch = B.conform(numbered.where(F.col("round") == i), "observations").join(
            obs.select("source", "external_id", "property_key").distinct(), ["source", "external_id"])
        state = M.stored(S.next_listings(S.merge_state(state, batch)), "state")
    want = fold_observations(numbered.where("round <= 4").drop("round"))
    cols = ["source", "external_id", "price", "title", "source_status_raw", "status", "vanished_at", "price_drop_count", "first_seen_at", "last_seen_at"]
    assert state.select(cols).exceptAll(want.select(cols)).count() == 0 and state.count() == want.count()


def make_listings(spark, rows):
    """rows: (source, id, property, status, hours since last seen, hours since vanished)"""
    data = [(s, i, p, st, hours_ago(500), hours_ago(h), None if v is None else hours_ago(v)) for s, i, p, st, h, v in rows]
    return spark.createDataFrame(
        data, "source STRING, external_id STRING, property_key STRING, status STRING, first_seen_at TIMESTAMP, last_seen_at TIMESTAMP, vanished_at TIMESTAMP")


EVENTS = "property_key STRING, source STRING, external_id STRING, event_type STRING, occurred_at TIMESTAMP"


def test_vanish_waits_for_all_sources(spark):
    listings = make_listings(spark, [("lun", "1", "p", "active", 12, None), ("domria", "2", "p", "active", 1, None)])
    events = spark.createDataFrame([], EVENTS)
    seen = spark.createDataFrame([("lun", "9")], "source STRING, external_id STRING")
    cfg = MarketConfig(min_seen_for_vanish=1, vanish_min_active_ratio=0.0)
    result = S.reconcile_vanish(listings, events, seen, now(), cfg=cfg)
    assert result.listings.where("newly_vanished").count() == 1
    assert result.new_events.count() == 0


def test_vanish_event_is_emitted_once(spark):
    listings = make_listings(spark, [("lun", "1", "p", "active", 12, None), ("domria", "2", "p", "vanished", 30, 20)])
    events = spark.createDataFrame([("p", "lun", "1", "appeared", hours_ago(400))], EVENTS)
    seen = spark.createDataFrame([("lun", "9")], "source STRING, external_id STRING")
    cfg = MarketConfig(min_seen_for_vanish=1, vanish_min_active_ratio=0.0)
    result = S.reconcile_vanish(listings, events, seen, now(), cfg=cfg)
    (event,) = result.new_events.collect()
    assert event.payload.level == "property" and event.payload.sources_vanished == ["domria", "lun"]
    after = events.unionByName(result.new_events.select(events.columns))
    again = S.vanish_events(result.listings.drop("newly_vanished"), after, now())
    assert again.count() == 0
    back = after.unionByName(spark.createDataFrame([("p", "lun", "1", "relisted", dt.datetime(2024, 6, 2))], EVENTS))
    assert S.vanish_events(result.listings.drop("newly_vanished"), back, now()).count() == 1


@pytest.mark.parametrize("active,seen,cfg,allowed", [
    (200, 80, MarketConfig(), False), (200, 50, MarketConfig(), False), (100, 60, MarketConfig(min_seen_for_vanish=50), True),
    (0, 120, MarketConfig(), True), (200, 110, MarketConfig(), True),
])
def test_coverage_guard(spark, active, seen, cfg, allowed):
    listings = spark.range(active).select(F.lit("lun").alias("source"), F.lit("active").alias("status"))
    ids = spark.range(seen).select(F.lit("lun").alias("source"), F.col("id").cast("string").alias("external_id"))
    (row,) = S.coverage_guard(ids, listings, cfg).collect()
    assert row.allowed == allowed


def candidate(spark, **over):
    base = dict(
        deal_type="rent", first_seen_at=hours_ago(960), vanished_at=hours_ago(0), last_price=1.0, previous_price=None,
        price_drop_count=1, active_on_other_sources=0, vanished_on_sources=2, tracked_sources_n=2,
        explicit_sold_or_rented=False, agency_bulk_delist=False, relisted_soon=False)
    base.update(over)
    schema = ("deal_type STRING, first_seen_at TIMESTAMP, vanished_at TIMESTAMP, last_price DOUBLE, previous_price DOUBLE, price_drop_count INT, "
              "active_on_other_sources INT, vanished_on_sources INT, tracked_sources_n INT, explicit_sold_or_rented BOOLEAN, agency_bulk_delist BOOLEAN, relisted_soon BOOLEAN")
    return D.score_deals(spark.createDataFrame([tuple(base.values())], schema)).first()


def test_deal_scores(spark):
    good = candidate(spark)
    assert (good.score, good.bucket) == (70, "likely_deal")
    assert [f.code for f in good.features] == ["vanished_all_sources", "price_drop", "typical_dom"]
    bad = candidate(spark, first_seen_at=hours_ago(24), price_drop_count=0, vanished_on_sources=1, tracked_sources_n=1)
    assert (bad.score, bad.bucket) == (0, "likely_withdrawn")
    assert candidate(spark, explicit_sold_or_rented=True, relisted_soon=True, agency_bulk_delist=True, active_on_other_sources=1).score == 20


def test_exclusion_rules(spark):
    names = [p.strip().split(" ", 1)[0] for p in EXTRA[len("STRUCT<"):-1].split(", ")]
    def extra(**on):
        return tuple(on.get(n) for n in names)

    rows = [(True, False, extra()), (False, True, extra(stats_auto_excluded=True)), (True, False, extra(stats_review_ok=True)), (False, True, extra(stats_exclude_manual=True))]
    df = spark.createDataFrame(rows, f"odd BOOLEAN, excluded BOOLEAN, raw_extra {EXTRA}")
    flag, auto = S.apply_exclusion(F.col("odd"), F.col("excluded"), F.col("raw_extra"))
    got = [(r.f, r.a) for r in df.select(flag.alias("f"), auto.alias("a")).collect()]
    assert got == [(True, True), (False, None), (False, None), (True, None)]


def test_daily_rows_are_replaced(spark, sf):
    path = scratch(spark, "daily")
    rows = listing_view(spark, sf).limit(50).withColumns({
        "district_norm": F.col("district"), "in_city": F.lit(True), "day": F.lit("2001-01-01").cast("date")})
    snap = M.market_snapshot(rows)
    B.upsert_daily(snap, path)
    B.upsert_daily(snap, path)
    B.upsert_daily(snap.withColumn("day", F.lit("2001-01-02").cast("date")), path)
    assert [str(r.day) for r in M.series(B.read_daily(spark, path)).collect()] == ["2001-01-01", "2001-01-02"]


def test_yield(spark):
    market = spark.createDataFrame(
        [("sale", "x", 4000.0, 4000.0, 20), ("rent", "x", 25.0, 25.0, 20), ("sale", None, 4000.0, 4000.0, 20), ("rent", None, 25.0, 25.0, 20)],
        "cohort STRING, district STRING, avg_psm DOUBLE, median_psm DOUBLE, n BIGINT")
    row = M.rough_yield(market).where("district = 'x'").first()
    assert (row.yield_pct, row.payback_years) == (7.5, 13.3)


def test_crawl_log_and_versions(spark):
    root = scratch(spark, "mart")
    B.log_run(spark, root, "lun", hours_ago(2), hours_ago(1), "ok", 3, 120)
    B.log_run(spark, root, "olx", hours_ago(2), hours_ago(1), "error", error="timeout")
    assert B.read_table(spark, root, "crawl_runs").count() == 2
    path = B.write_version(spark.range(3), root, "t", "1")
    assert spark.read.parquet(path).count() == 3


def test_crawl_to_deals(spark):
    """Two crawls: an office on two portals vanishes and becomes a likely deal."""
    def crawl(ids, day):
        rows = [(s, i, f"http://x/{i}", "rent", "Офіс 120 м²", 2000.0 - 100 * day, "USD", 120.0, 4, "вул. Лугова, 16", "Печерський", dt.datetime(2024, 5, 1 + day), n)
                for n, (s, i) in enumerate(ids)]
        df = spark.createDataFrame(
            rows, "source STRING, external_id STRING, url STRING, deal_type STRING, title STRING, price DOUBLE, currency STRING, area_sqm DOUBLE, "
            "floor INT, address_raw STRING, district STRING, seen_at TIMESTAMP, seq BIGINT")
        return M.stored(S.clean_observations(B.conform(df, "observations")), "batch")

    empty = {n: spark.createDataFrame([], TABLES[n]) for n in ("listings", "properties", "events")}
    first = crawl([("lun", "1"), ("domria", "2")], 0)
    merged = S.merge_state(empty["listings"], first)
    listings, (props, born) = M.stored(S.next_listings(merged), "l"), S.merge_properties(empty["properties"], first)
    events = M.stored(S.merge_events(merged).unionByName(born), "e")
    assert props.count() == 1 and events.count() == 3 and S.merge_snapshots(merged, listings).count() == 2
    second = crawl([("lun", "1"), ("lun", "7"), ("domria", "8")], 10)
    merged = S.merge_state(listings, second)
    after = M.stored(S.next_listings(merged), "l")
    assert after.where("external_id = '1' and price_drop_count = 1 and price = 1000.0").count() == 1
    seen = spark.createDataFrame([("lun", "7"), ("domria", "8")], "source STRING, external_id STRING")
    late = F.lit("2024-06-01 00:00:00").cast("timestamp")
    cfg = MarketConfig(min_seen_for_vanish=1, vanish_min_active_ratio=0.0)
    key = listings.first().property_key
    only = after.where(~F.col("external_id").isin("7", "8")).withColumn("property_key", F.lit(key))
    result = S.reconcile_vanish(only, events, seen, late, props, cfg)
    assert result.new_events.count() == 1 and result.properties.first().is_active is False
    scored = D.rescore_all(result.listings.drop("newly_vanished"), events.unionByName(result.new_events), late).first()
    assert scored.score >= 45 and scored.vanished_on_sources == 2
    hyps = D.merge_hypotheses(spark.createDataFrame([], TABLES["hypotheses"]), D.rescore_all(result.listings, events, late), late)
    assert hyps.count() == 1


def test_search_filters(spark, sf):
    rows = listing_view(spark, sf)
    assert X.range_filter(rows, 100, None).where("price is null").count() == 0
    assert Q.price_audit(rows.withColumn("raw_extra", F.lit(None).cast(EXTRA))).count() == 8


def test_plans_hold_no_python_rows_and_no_products(spark, sf):
    from lotlens.plans import catalog

    for name in ("market_sale_by_district", "missing_listings", "deal_scores", "saved_filter_matches", "change_events"):
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan, name


def test_change_events_of_statuses(spark):
    rows = [("s", "1", d, d, p, st) for d, p, st in ((1, 10.0, None), (2, 9.0, None), (3, None, "sold"), (9, 9.0, None))]
    obs = spark.createDataFrame(
        [(s, i, dt.datetime(2024, 1, d), q, p, st) for s, i, d, q, p, st in rows],
        "source STRING, external_id STRING, seen_at TIMESTAMP, seq BIGINT, price DOUBLE, source_status_raw STRING"
    ).withColumns({c: F.lit(None).cast("string") for c in ("currency", "title", "description", "phone")}).withColumn("area_sqm", F.lit(None).cast("double"))
    got = [(r.event_type, r.occurred_at.day) for r in change_events(track_observations(obs)).orderBy("occurred_at").collect()]
    assert got == [("appeared", 1), ("price_changed", 2), ("status_changed", 3)]


def test_saved_filters_with_and_without_the_text_index(spark):
    """Texts of every length, in any field, with blanks and upper case, beside filters without one."""
    from lotlens.operators.search import match_watches

    rows = spark.sql("""SELECT 's' || id % 2 AS source, CAST(id AS STRING) AS external_id, 'sale' AS deal_type, 'office' AS property_type, IF(id % 5 = 0, NULL, 'D' || id % 3) AS district,
        IF(id % 7 = 0, NULL, 'Lot Київ ' || id) AS title, 'street ' || id % 9 AS address_raw, IF(id % 2 = 0, 'Київ', '') AS city, CAST(id AS DOUBLE) AS price, 'USD' AS currency,
        timestamp'2024-01-01' AS first_seen_at, id % 4 = 0 AS below_market FROM range(60)""")
    filters = [("a", None, None, None), ("b", "", "s1", None), ("c", "  ", None, None), ("d", "t", None, None), ("e", "ЇВ", None, None), ("f", "КИЇВ", None, 9.0), ("g", "lot київ 1", "s1", None),
               ("h", "d1", None, None), ("i", "nowhere", None, None), ("j", "aaa", "s0", None), ("k", " Street 3 ", None, None), ("k", "street 3", None, None)]
    watches = spark.createDataFrame(filters, "name STRING, q STRING, source STRING, price_min DOUBLE").selectExpr(
        "*", *[f"CAST(NULL AS STRING) AS {c}" for c in ("deal_type", "segment", "district", "period")], "false AS below_market", "CAST(NULL AS DOUBLE) AS price_max")
    now = F.to_timestamp(F.lit("2024-02-01"))
    plain, indexed = (sorted(map(tuple, match_watches(watches, rows, now, index_from=n).collect())) for n in (10**6, 1))
    held = [r.asDict() for r in rows.collect()]
    want = []
    for name, q, source, low in filters:
        text = None if q in (None, "") else q.strip(" ").lower()
        for r in held:
            hit = text is None or any(r[c] is not None and text in r[c].lower() for c in ("title", "address_raw", "district", "city"))
            if hit and (not source or source == r["source"]) and (low is None or r["price"] >= low):
                want.append((name, r["source"], r["external_id"]))
    assert plain == sorted(want) and indexed == plain
    assert match_watches(watches.limit(0), rows, now, index_from=1).count() == 0 and match_watches(watches, rows.limit(0), now, index_from=1).count() == 0


def test_first_pages_equal_whole_sorts(spark):
    """With cuts and without them; ties beyond the page, nulls, fewer rows than a page."""
    from lotlens.config import SORT_MODES
    from lotlens.operators.search import first_pages, sort_listings

    rows = spark.sql("""SELECT 's' AS source, CAST(id AS STRING) AS external_id, 'sale' AS deal_type, 'active' AS status, IF(id % 3 = 0, NULL, CAST(id * 7919 % 4000 AS DOUBLE)) AS price, 'USD' AS currency,
        CAST(NULL AS DOUBLE) AS price_per_sqm, IF(id < 3990, NULL, 50D) AS area_sqm, timestamp_seconds(1700000000 + id % 5 * 86400) AS first_seen_at FROM range(4000)""")
    now = F.to_timestamp(F.lit("2024-02-01"))
    for part, n in ((rows, 20), (rows.limit(7), 20), (rows.limit(0), 20), (rows, 1)):
        part = part.cache()
        got = {}
        for r in first_pages(part, SORT_MODES, now, n).collect():
            got.setdefault(r.mode, {})[r["rank"]] = r.external_id
        for mode in SORT_MODES:
            want = [r.external_id for r in sort_listings(part, mode, now).limit(n).collect()]
            assert [got.get(mode, {})[i + 1] for i in range(len(got.get(mode, {})))] == want, mode


def test_saved_filters_beyond_a_broadcast_are_joined_in_cells(spark):
    """One text of many filters and listings is dealt over cells; filters without a text, equal filters and equal listings beside it."""
    from lotlens.operators import search

    rows = spark.sql("""SELECT 's' || id % 2 AS source, CAST(id % 140 AS STRING) AS external_id, 'sale' AS deal_type, 'office' AS property_type, CAST(NULL AS STRING) AS district,
        'Lot ' || id % 140 AS title, 'Main street ' || id % 3 AS address_raw, CAST(NULL AS STRING) AS city, CAST(id % 140 AS DOUBLE) AS price, 'USD' AS currency,
        timestamp'2024-01-01' AS first_seen_at, false AS below_market FROM range(150)""")
    watches = spark.sql("""SELECT 'w' || id % 38 AS name, CASE WHEN id % 20 = 0 THEN '' WHEN id % 20 = 1 THEN 'LO' WHEN id % 4 = 2 THEN 'lot 1' || id % 7 ELSE ' Street 1' END AS q, IF(id % 3 = 0, 's1', NULL) AS source,
        CAST(NULL AS STRING) AS deal_type, '' AS segment, CAST(NULL AS STRING) AS district, CAST(NULL AS STRING) AS period, false AS below_market,
        CAST(id % 9 AS DOUBLE) AS price_min, IF(id % 5 = 0, NULL, CAST(120 - id AS DOUBLE)) AS price_max FROM range(40)""")
    now = F.to_timestamp(F.lit("2024-02-01"))
    want = sorted(map(tuple, search.match_watches(watches, rows, now, index_from=10**6).collect()))
    for index_from in (1, 10**6):
        got = search.match_watches(watches, rows, now, index_from=index_from, broadcast_rows=0, cell=(20, 4))
        assert sorted(map(tuple, got.collect())) == want and len(want) > 500
    side = spark.sql("SELECT CAST(id AS STRING) AS name, IF(id < 90, 'hot', 'k' || id) AS _wkey, 1000L AS _n FROM range(100)")
    keys = spark.sql("SELECT CAST(id AS STRING) AS external_id, CASE WHEN id < 1000 THEN 'hot' WHEN id < 1010 THEN 'k95' ELSE 'none' END AS _lkey FROM range(2000)")
    left, right, at = search._in_cells(keys, side, (100, 10))
    joined = left.join(right, [left._lkey == right._wkey, *[left[c] == right[f"_w{c}"] for c in at]])
    cells = [r["count"] for r in joined.groupBy("_lkey", *at).count().collect()]
    assert joined.count() == joined.select("name", "external_id").distinct().count() == 90 * 1000 + 10 and max(cells) < 4 * 100 * 10
    assert left.where("_lkey = 'none'").count() == 0
