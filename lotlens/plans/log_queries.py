"""Change detection, state, vanish and activity queries over the observation log."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotlens.config import MarketConfig
from lotlens.operators import activity as A
from lotlens.operators import changes as C
from lotlens.operators import state as S
from lotlens.operators.ingest import ingest_crawl, mart_tables
from lotlens.operators.relational import earliest_by
from lotlens.plans.check_sql import (
    ACTIVE, LISTINGS_AS_OF as SQL_AS_OF, LOG_AS_OF as SQL_LOG_AS_OF, LV, MART, MISSED_BY_RUN, OBS, RUNS, mapped, tracked, ts, with_,
)
from lotlens.plans.mart import log_mart
from lotlens.plans.registry import big, query, stamp
from lotlens.plans.views import LISTINGS_AS_OF, LOG_AS_OF, as_of, listing_view, observation_view
from lotlens.session import scratch, stored
from lotlens.sources.tables import append, conform

KEY = C.KEY
RUN_TRACK = (OBS, RUNS, tracked(MISSED_BY_RUN))


def _now():
    return as_of(LOG_AS_OF)


def _runs(obs):
    return C.approved_runs(obs, 5)


@query("first_card_per_listing", with_(OBS, body=f"""SELECT source, external_id, seq, {ts('seen_at')}, price FROM obs
QUALIFY row_number() OVER (PARTITION BY source, external_id ORDER BY seq) = 1"""))
def first_card(spark, root):
    return C.dedupe_batch(observation_view(spark, root)).select(*KEY, "seq", stamp("seen_at"), "price")


@query("union_of_sources", with_(OBS, body="SELECT source, count(*) AS n, count(DISTINCT external_id) AS listings FROM obs GROUP BY source"))
def union_of_sources(spark, root):
    obs = observation_view(spark, root)
    sale = F.coalesce(F.col("deal_type") == "sale", F.lit(False))
    # the second frame has other columns in another order, as cards of another portal
    return C.union_sources(obs.where(sale), obs.where(~sale).select("seq", "external_id", "source", "seen_at")).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("external_id").alias("listings"))


@query("change_events", with_(*RUN_TRACK, body=f"""SELECT source, external_id, event_type, {ts('occurred_at')}, old_price, new_price, old_status, new_status,
  {ts('previous_vanished_at')} FROM chg"""))
def change_events(spark, root):
    obs = observation_view(spark, root)
    return C.diff_observations(obs, _runs(obs)).select(
        *KEY, "event_type", stamp("occurred_at"), "payload.old_price", "payload.new_price", "payload.old_status", "payload.new_status",
        F.date_format("payload.previous_vanished_at", "yyyy-MM-dd HH:mm:ss").alias("previous_vanished_at"))


@query("price_drop_counts", with_(OBS, tracked("CAST(NULL AS TIMESTAMP)"), body=f"""SELECT source, external_id, seq, {ts('seen_at')},
  CAST(sum(CASE WHEN price_dropped THEN 1 ELSE 0 END) OVER (PARTITION BY source, external_id ORDER BY seen_at, seq) AS BIGINT) AS price_drop_count FROM trk"""))
def price_drop_counts(spark, root):
    rows = C.track_observations(observation_view(spark, root), drop_counts=True)
    return rows.select(*KEY, "seq", stamp("seen_at"), *big("price_drop_count"))


SNAPSHOT = """prev_seen_at IS NULL OR coalesce(abs(price - prev_price) >= 0.01, price IS NOT NULL OR prev_price IS NOT NULL)
  OR (title IS NOT NULL AND title <> coalesce(prev_title, '')) OR coalesce(abs(area_sqm - prev_area_sqm) >= 0.01, area_sqm IS NOT NULL OR prev_area_sqm IS NOT NULL)
  OR (source_status_raw IS NOT NULL AND source_status_raw IS DISTINCT FROM prev_source_status_raw)
  OR (description IS NOT NULL AND description <> coalesce(prev_description, '')) OR (phone IS NOT NULL AND prev_phone IS NULL) OR stored_status = 'vanished'"""


@query("snapshot_rows", with_(*RUN_TRACK, body=f"SELECT source, external_id, seq, price, title FROM trk WHERE {SNAPSHOT}"))
def snapshot_rows(spark, root):
    obs = observation_view(spark, root)
    return C.needs_snapshot(C.track_observations(obs, _runs(obs))).select(*KEY, "seq", "price", "title")


@query("appended_events", with_(MART, body="SELECT event_type, strftime(occurred_at, '%Y-%m-%d') AS day, count(*) AS n FROM ev GROUP BY 1, 2"))
def appended_events(spark, root):
    """Events appended to a table partitioned by day, then counted from it."""
    path = scratch(spark, "mart")
    append(log_mart(spark, root)["events"], path, "events", "occurred_at")
    return spark.read.parquet(f"{path}/events").groupBy("event_type", F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("listing_state", with_(MART, body=f"""SELECT source, external_id, status, price, title, source_status_raw, price_drop_count, {ts('first_seen_at')}, {ts('last_seen_at')},
  {ts('vanished_at')} FROM ls"""))
def listing_state(spark, root):
    return log_mart(spark, root)["listings"].select(
        *KEY, "status", "price", "title", "source_status_raw", "price_drop_count", stamp("first_seen_at"), stamp("last_seen_at"), stamp("vanished_at"))


# --- merge of one batch into stored state ------------------------------------------------------

# Days from the cut on are crawls of their own: a crawl keeps the first card of a listing. Crawls up to FIRST are one batch.
CUT, FIRST = "2024-01-20 00:00:00", "2024-01-29 00:00:00"
NEVER = "CAST(NULL AS TIMESTAMP)"


def _crawls_sql(cut: str) -> str:
    """The log with one card per listing and day after the cut."""
    return OBS.replace("obs AS (", "obs0 AS (", 1) + f""",
obs AS (SELECT * FROM obs0 WHERE seen_at < TIMESTAMP '{cut}'
  UNION ALL (SELECT * FROM obs0 WHERE seen_at >= TIMESTAMP '{cut}' QUALIFY row_number() OVER (PARTITION BY source, external_id, date_trunc('day', seen_at) ORDER BY seq) = 1))"""


FOLD_SQL = f"""fold AS (SELECT source, external_id, arg_max(price, (seen_at, seq)) FILTER (price IS NOT NULL) AS price, arg_max(title, (seen_at, seq)) FILTER (title IS NOT NULL) AS title,
  arg_max(source_status_raw, (seen_at, seq)) FILTER (source_status_raw IS NOT NULL) AS raw, min(seen_at) AS first_seen_at, max(seen_at) AS last_seen_at FROM obs GROUP BY 1, 2),
state AS (SELECT source, external_id, price, title, {mapped('raw')} AS status, {ts('first_seen_at')}, {ts('last_seen_at')} FROM fold)"""


def _stored_and_cards(spark, root, cut):
    """Listings as of the cut, and the cards after it, one per listing and day."""
    obs = observation_view(spark, root)
    folded = C.fold_observations(obs.where(F.col("seen_at") < as_of(cut))).withColumns({
        "exclude_from_stats": F.lit(False), "created_at": F.col("first_seen_at")})
    day = F.to_date("seen_at")
    cards = earliest_by(obs.where(F.col("seen_at") >= as_of(cut)).withColumn("day", day), [*KEY, "day"], [F.col("seq")])
    keyed = conform(cards, "observations").withColumn("property_key", F.col("external_id"))
    return conform(folded, "listings"), keyed


@query("merged_listings", with_(_crawls_sql(CUT), FOLD_SQL, body="SELECT * FROM state"))
def merged_listings(spark, root):
    listings, cards = _stored_and_cards(spark, root, CUT)
    after = S.next_listings(S.merge_state(listings, S.fold_cards(cards, stored(S.track_cards(listings, cards), "tracked"))))
    return after.select(*KEY, "price", "title", "status", stamp("first_seen_at"), stamp("last_seen_at"))


@query("merge_events", with_(_crawls_sql(CUT), tracked(NEVER), body=f"SELECT source, external_id, event_type, {ts('occurred_at')} FROM chg WHERE occurred_at >= TIMESTAMP '{CUT}'"))
def merge_events(spark, root):
    listings, cards = _stored_and_cards(spark, root, CUT)
    return C.change_events(S.track_cards(listings, cards)).select(*KEY, "event_type", stamp("occurred_at"))


def _ingested(spark, root):
    """The mart after batch 0 (listings as of FIRST) and the daily crawls that follow, each one committed."""
    key = f"ingest {spark.sparkContext.applicationId} {root}"
    if key not in _INGESTED:
        mart = mart_tables(spark, scratch(spark, "ingest"), parts=8)
        listings, cards = _stored_and_cards(spark, root, FIRST)
        mart.commit(0, {"listings": (listings, range(8))})
        days = [r[0] for r in cards.select(F.to_date("seen_at").alias("day")).distinct().orderBy("day").collect()]
        for n, day in enumerate(days):
            ingest_crawl(mart, n + 1, cards.where(F.to_date("seen_at") == F.lit(day)))
        _INGESTED[key] = mart
    return _INGESTED[key]


_INGESTED: dict = {}


@query("ingest_listings", with_(_crawls_sql(FIRST), FOLD_SQL, body="SELECT * FROM state"))
def ingest_listings(spark, root):
    rows = _ingested(spark, root).read("listings")
    return rows.select(*KEY, "price", "title", "status", stamp("first_seen_at"), stamp("last_seen_at"))


@query("ingest_events", with_(_crawls_sql(FIRST), tracked(NEVER), body=f"""SELECT source, external_id, event_type, {ts('occurred_at')}, old_price, new_price FROM chg WHERE occurred_at >= TIMESTAMP '{FIRST}'
UNION ALL SELECT NULL, external_id, 'appeared', strftime(min(seen_at), '%Y-%m-%d %H:%M:%S'), NULL, NULL FROM obs WHERE seen_at >= TIMESTAMP '{FIRST}' GROUP BY external_id"""))
def ingest_events(spark, root):
    """Events of listings, and the first event of premises that the crawls brought."""
    rows = _ingested(spark, root).read("events")
    return rows.select("source", F.coalesce("external_id", "property_key").alias("external_id"), "event_type", stamp("occurred_at"), "payload.old_price", "payload.new_price")


@query("ingest_snapshots", with_(_crawls_sql(FIRST), tracked(NEVER), body=f"""SELECT source, external_id, strftime(seen_at, '%Y-%m-%d %H:%M:%S') AS crawled_at, mapped_status AS status
FROM trk WHERE seen_at >= TIMESTAMP '{FIRST}' AND ({SNAPSHOT})"""))
def ingest_snapshots(spark, root):
    return _ingested(spark, root).read("snapshots").select(*KEY, stamp("crawled_at"), "status")


@query("ingest_premises", with_(_crawls_sql(FIRST), body=f"""SELECT external_id AS fingerprint, {ts('first_seen_at')}, {ts('last_seen_at')}, is_active FROM (
  SELECT external_id, min(seen_at) AS first_seen_at, max(seen_at) AS last_seen_at, true AS is_active FROM obs WHERE seen_at >= TIMESTAMP '{FIRST}' GROUP BY 1)"""))
def ingest_premises(spark, root):
    return _ingested(spark, root).read("properties").select("fingerprint", stamp("first_seen_at"), stamp("last_seen_at"), "is_active")


# --- coverage guard and vanish ------------------------------------------------------------------

GUARD_CFG = MarketConfig(min_seen_for_vanish=20, vanish_min_active_ratio=0.55)
SEEN_SQL = f"""seen AS (SELECT source, external_id FROM lv WHERE last_seen_at >= {SQL_AS_OF} - INTERVAL 1300 DAY AND listing_id % 10 <> 0),
g0 AS (SELECT coalesce(s.source, a.source) AS source, coalesce(s.seen, 0) AS seen, coalesce(a.active, 0) AS active
  FROM (SELECT source, count(DISTINCT external_id) AS seen FROM seen GROUP BY 1) s
  FULL JOIN (SELECT source, count(*) AS active FROM lv WHERE {ACTIVE} GROUP BY 1) a ON s.source = a.source),
guard AS (SELECT *, seen > 0 AND seen >= 20 AND (active <= 0 OR seen / active >= 0.55) AS allowed FROM g0)"""


def _listings_seen(spark, root):
    rows = listing_view(spark, root)
    start = as_of(LISTINGS_AS_OF) - F.expr("INTERVAL 1300 DAYS")
    return rows, rows.where((F.col("last_seen_at") >= start) & (F.col("listing_id") % 10 != 0)).select(*KEY)


@query("coverage_guard", with_(LV, SEEN_SQL, body="""SELECT source, seen, active, allowed, CASE WHEN seen <= 0 THEN 'seen=0' WHEN seen < 20 THEN printf('seen=%d < min=20', seen)
  WHEN active <= 0 THEN printf('no active baseline, seen=%d', seen) WHEN seen / active < 0.55 THEN printf('seen/active=%.2f%% < 55%% (partial crawl?)', seen / active * 100)
  ELSE printf('seen=%d, active=%d, ratio=%.2f%%', seen, active, seen / active * 100) END AS reason FROM guard"""))
def coverage_guard(spark, root):
    rows, seen = _listings_seen(spark, root)
    return S.coverage_guard(seen, rows, GUARD_CFG).select("source", *big("seen", "active"), "allowed", "reason")


MISSING_SQL = f"""missing AS (SELECT lv.* FROM lv JOIN guard g ON g.source = lv.source AND g.allowed WHERE {ACTIVE} AND last_seen_at < {SQL_AS_OF} - INTERVAL 6 HOUR
  AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.source = lv.source AND s.external_id = lv.external_id))"""


@query("missing_listings", with_(LV, SEEN_SQL, MISSING_SQL, body="SELECT source, external_id, status FROM missing"))
def missing_listings(spark, root):
    rows, seen = _listings_seen(spark, root)
    guard = S.coverage_guard(seen, rows, GUARD_CFG)
    return S.missing_listings(rows, seen, as_of(LISTINGS_AS_OF), guard).select(*KEY, "status")


MARKED_SQL = f"""marked AS (SELECT lv.* EXCLUDE (status, vanished_at), CASE WHEN m.external_id IS NOT NULL THEN 'vanished' ELSE lv.status END AS status,
    CASE WHEN m.external_id IS NOT NULL THEN {SQL_AS_OF} ELSE lv.vanished_at END AS vanished_at, m.external_id IS NOT NULL AS newly
  FROM lv LEFT JOIN missing m ON m.source = lv.source AND m.external_id = lv.external_id)"""


@query("marked_vanished", with_(LV, SEEN_SQL, MISSING_SQL, MARKED_SQL, body="SELECT source, status, count(*) AS n, count(*) FILTER (newly) AS newly FROM marked GROUP BY 1, 2"))
def marked_vanished(spark, root):
    rows, seen = _listings_seen(spark, root)
    marked = S.mark_vanished(rows, seen, as_of(LISTINGS_AS_OF), S.coverage_guard(seen, rows, GUARD_CFG))
    return marked.groupBy("source", "status").agg(F.count(F.lit(1)).alias("n"), F.count_if("newly_vanished").alias("newly"))


VANISH_SQL = f"""sets AS (SELECT property_key, count(*) FILTER ({ACTIVE}) AS active, list_sort(list(DISTINCT source) FILTER (status = 'vanished')) AS gone FROM marked GROUP BY 1),
told AS (SELECT g.property_key FROM (SELECT property_key, max(occurred_at) AS at FROM pe WHERE event_type = 'vanished' GROUP BY 1) g
  LEFT JOIN (SELECT property_key, max(occurred_at) AS at FROM pe WHERE event_type IN ('appeared', 'relisted') GROUP BY 1) r ON g.property_key = r.property_key
  WHERE r.at IS NULL OR g.at >= r.at),
rep AS (SELECT * FROM marked WHERE status = 'vanished' QUALIFY row_number() OVER (PARTITION BY property_key ORDER BY vanished_at DESC, last_seen_at DESC, source DESC, external_id DESC) = 1),
fresh AS (SELECT s.property_key, r.source, r.external_id, array_to_string(s.gone, ',') AS sources_vanished FROM sets s JOIN rep r ON s.property_key = r.property_key
  WHERE s.active = 0 AND s.property_key IN (SELECT property_key FROM marked WHERE newly) AND s.property_key NOT IN (SELECT property_key FROM told))"""
# Premises events of the listing view: appeared with the first listing, vanished with the last gone one.
PROPERTY_EVENTS = """pe AS (SELECT property_key, 'appeared' AS event_type, min(first_seen_at) AS occurred_at FROM lv GROUP BY 1
  UNION ALL SELECT property_key, 'vanished', max(vanished_at) FROM lv WHERE property_id % 3 = 0 GROUP BY 1 HAVING max(vanished_at) IS NOT NULL
  UNION ALL SELECT property_key, 'relisted', max(last_seen_at) FROM lv WHERE property_id % 6 = 0 GROUP BY 1)"""


def _premises_events(rows):
    def part(df, kind, at):
        return df.groupBy("property_key").agg(at.alias("occurred_at")).select("property_key", F.lit(kind).alias("event_type"), "occurred_at")

    first = part(rows, "appeared", F.min("first_seen_at"))
    gone = part(rows.where(F.col("property_id") % 3 == 0), "vanished", F.max("vanished_at")).where(F.col("occurred_at").isNotNull())
    back = part(rows.where(F.col("property_id") % 6 == 0), "relisted", F.max("last_seen_at"))
    return first.unionByName(gone).unionByName(back)


@query("premises_vanish_events", with_(LV, SEEN_SQL, MISSING_SQL, MARKED_SQL, PROPERTY_EVENTS, VANISH_SQL, body="SELECT * FROM fresh"))
def premises_vanish_events(spark, root):
    rows, seen = _listings_seen(spark, root)
    result = S.reconcile_vanish(rows, _premises_events(rows), seen, as_of(LISTINGS_AS_OF), cfg=GUARD_CFG)
    return result.new_events.select("property_key", *KEY, F.array_join("payload.sources_vanished", ",").alias("sources_vanished"))


@query("vanish_pass_by_source", with_(LV, SEEN_SQL, MISSING_SQL, MARKED_SQL, body="""SELECT g.source, g.allowed, count(m.external_id) FILTER (m.newly) AS vanished FROM guard g
LEFT JOIN marked m ON m.source = g.source GROUP BY 1, 2"""))
def vanish_pass(spark, root):
    rows, seen = _listings_seen(spark, root)
    result = S.reconcile_vanish(rows, _premises_events(rows), seen, as_of(LISTINGS_AS_OF), cfg=GUARD_CFG)
    counts = result.listings.groupBy("source").agg(F.count_if("newly_vanished").alias("vanished"))
    return result.guard.join(counts, "source").select("source", "allowed", "vanished")


@query("last_reactivation", with_(MART, body="SELECT property_key, strftime(max(occurred_at), '%Y-%m-%d %H:%M:%S') AS reactivated_at FROM ev WHERE event_type IN ('appeared', 'relisted') GROUP BY 1"))
def last_reactivation(spark, root):
    return A.last_reactivation(log_mart(spark, root)["events"]).select("property_key", stamp("reactivated_at"))


# --- activity -----------------------------------------------------------------------------------


@query("relist_events_of_sales", with_(MART, body=f"""SELECT e.source, e.external_id, strftime(e.occurred_at, '%Y-%m-%d %H:%M:%S') AS occurred_at, l.status
FROM ev e JOIN ls l ON e.source = l.source AND e.external_id = l.external_id WHERE e.event_type = 'relisted' AND l.deal_type = 'sale' AND e.occurred_at >= {SQL_LOG_AS_OF} - INTERVAL 240 HOUR"""))
def listing_events(spark, root):
    mart = log_mart(spark, root)
    rows = A.listing_events(mart["events"], mart["listings"], "relisted", A.since(_now(), 240), "sale")
    return rows.select(*KEY, stamp("occurred_at"), "status")


@query("listing_event_counts", with_(MART, body=f"""SELECT e.event_type, count(*) AS n FROM ev e JOIN ls l ON e.source = l.source AND e.external_id = l.external_id
WHERE l.deal_type = 'rent' AND e.occurred_at >= {SQL_LOG_AS_OF} - INTERVAL 240 HOUR GROUP BY 1"""))
def listing_event_counts(spark, root):
    mart = log_mart(spark, root)
    return A.count_listing_events(mart["events"], mart["listings"], A.since(_now(), 240), "rent").select("event_type", *big("n"))


@query("premises_events_of_rents", with_(MART, body=f"""SELECT e.property_key, e.source, e.external_id, strftime(e.occurred_at, '%Y-%m-%d %H:%M:%S') AS occurred_at, p.is_active
FROM ev e JOIN pr p ON e.property_key = p.property_key WHERE e.event_type = 'vanished' AND p.deal_type = 'rent' AND e.occurred_at >= {SQL_LOG_AS_OF} - INTERVAL 240 HOUR"""))
def property_events(spark, root):
    mart = log_mart(spark, root)
    rows = A.property_events(mart["events"], mart["properties"], "vanished", A.since(_now(), 240), "rent")
    return rows.select("property_key", *KEY, stamp("occurred_at"), "is_active")


@query("vanished_premises", with_(MART, body=f"""SELECT DISTINCT e.property_key FROM ev e JOIN pr p ON e.property_key = p.property_key
WHERE e.event_type = 'vanished' AND p.deal_type = 'sale' AND e.occurred_at >= {SQL_LOG_AS_OF} - INTERVAL 72 HOUR"""))
def vanished_premises(spark, root):
    mart = log_mart(spark, root)
    return A.vanished_properties(mart["events"], mart["properties"], A.since(_now(), 72), "sale")


@query("price_drop_listings", with_(MART, body=f"""SELECT source, external_id, strftime(max(occurred_at), '%Y-%m-%d %H:%M:%S') AS occurred_at FROM ev
WHERE event_type = 'price_changed' AND new_price < old_price AND deal_type = 'sale' AND occurred_at >= {SQL_LOG_AS_OF} - INTERVAL 72 HOUR GROUP BY 1, 2"""))
def price_drop_listings(spark, root):
    mart = log_mart(spark, root)
    return A.price_drop_ids(mart["events"], A.since(_now(), 72), mart["listings"], "sale").select(*KEY, stamp("occurred_at"))


VIDS = f"""vids AS (
  SELECT n.property_key, coalesce(n.source, r.source) AS source, coalesce(n.external_id, r.external_id) AS external_id, n.occurred_at FROM (
    SELECT e.* FROM ev e JOIN pr p ON e.property_key = p.property_key WHERE e.event_type = 'vanished' AND p.deal_type = 'sale' AND e.occurred_at >= {SQL_LOG_AS_OF} - INTERVAL 72 HOUR
    QUALIFY row_number() OVER (PARTITION BY e.property_key ORDER BY e.occurred_at DESC, e.source DESC, e.external_id DESC) = 1) n
  LEFT JOIN (SELECT * FROM ls WHERE status = 'vanished' QUALIFY row_number() OVER (PARTITION BY property_key ORDER BY vanished_at DESC, last_seen_at DESC, source DESC, external_id DESC) = 1) r
    ON r.property_key = n.property_key)"""


def _vanished_ids(spark, root):
    mart = log_mart(spark, root)
    return A.vanished_listing_ids(mart["events"], mart["listings"], mart["properties"], A.since(_now(), 72), "sale")


@query("vanished_listing_per_premises", with_(MART, VIDS, body=f"SELECT property_key, source, external_id, {ts('occurred_at')} FROM vids"))
def vanished_listing_ids(spark, root):
    return _vanished_ids(spark, root).select("property_key", *KEY, stamp("occurred_at"))


@query("listings_by_activity_rank", with_(MART, VIDS, body="""SELECT l.source, l.external_id, l.status, strftime(v.occurred_at, '%Y-%m-%d %H:%M:%S') AS occurred_at
FROM vids v JOIN ls l ON l.source = v.source AND l.external_id = v.external_id"""))
def by_activity_rank(spark, root):
    """All listings of the activity order, newest first."""
    return A.by_activity_rank(log_mart(spark, root)["listings"], _vanished_ids(spark, root)).select(*KEY, "status", stamp("occurred_at"))


@query("recent_events", with_(MART, body=f"""SELECT source, external_id, event_type, strftime(occurred_at, '%Y-%m-%d %H:%M:%S') AS occurred_at FROM ev e
WHERE occurred_at >= {SQL_LOG_AS_OF} - INTERVAL 24 HOUR ORDER BY e.occurred_at DESC, source, external_id, event_type LIMIT 40"""))
def recent_events(spark, root):
    rows = A.recent(log_mart(spark, root)["events"], "occurred_at", _now(), 24, 40, [*KEY, "event_type"])
    return rows.select(*KEY, "event_type", stamp("occurred_at"))


@query("events_of_a_type", with_(MART, body="""SELECT e.source, e.external_id, strftime(e.occurred_at, '%Y-%m-%d %H:%M:%S') AS occurred_at FROM ev e WHERE event_type = 'status_changed'
ORDER BY e.occurred_at DESC, sha1(e.source || '|' || e.external_id || '|' || e.event_type || '|' || CAST(e.occurred_at AS VARCHAR)) LIMIT 100"""))
def list_events(spark, root):
    return A.list_events(log_mart(spark, root)["events"], "status_changed", 100).select(*KEY, stamp("occurred_at"))


@query("previous_prices", with_(MART, body="SELECT source, external_id, arg_max(old_price, occurred_at) AS previous_price FROM ev WHERE event_type = 'price_changed' GROUP BY 1, 2"))
def previous_prices(spark, root):
    return A.previous_price(log_mart(spark, root)["events"])


@query("relisted_soon", with_(MART, body=f"SELECT DISTINCT property_key FROM ev WHERE event_type = 'relisted' AND occurred_at >= {SQL_LOG_AS_OF} - INTERVAL 14 DAY"))
def relisted_soon(spark, root):
    return A.relisted_properties(log_mart(spark, root)["events"], _now())

