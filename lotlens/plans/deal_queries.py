"""Deal candidates, scores, labels and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotlens.operators import deals as D
from lotlens.operators import state as S
from lotlens.plans.check_sql import LISTINGS_AS_OF as SQL_AS_OF, LOG_AS_OF as SQL_LOG_AS_OF, LV, MART, with_
from lotlens.operators.ingest import mart_tables, vanish_crawl
from lotlens.plans.log_queries import GUARD_CFG, MARKED_SQL, MISSING_SQL, PROPERTY_EVENTS, SEEN_SQL, VANISH_SQL, _listings_seen, _premises_events
from lotlens.plans.registry import big, query, stamp
from lotlens.plans.views import LISTINGS_AS_OF, as_of, listing_view
from lotlens.session import scratch, stored
from lotlens.sources.tables import conform

KEY = S.KEY
ACTIVE = "status IN ('active', 'relisted')"
# Price changes of the listing view: a listing with drops once cost a tenth more.
EVENTS_SQL = """pe AS (SELECT property_key, 'appeared' AS event_type, min(first_seen_at) AS occurred_at FROM lv GROUP BY 1
  UNION ALL SELECT property_key, 'relisted', max(last_seen_at) FROM lv WHERE property_id % 6 = 0 GROUP BY 1),
pc AS (SELECT source, external_id, price * 1.1 AS old_price FROM lv WHERE listing_id % 8 = 0 AND price IS NOT NULL)"""


def _events(rows):
    changes = rows.where((F.col("listing_id") % 8 == 0) & F.col("price").isNotNull()).select(
        *KEY, "property_key", F.lit("price_changed").alias("event_type"), F.col("first_seen_at").alias("occurred_at"),
        F.struct((F.col("price") * 1.1).alias("old_price"), F.col("price").alias("new_price")).alias("payload"))
    return changes.unionByName(_premises_events(rows), allowMissingColumns=True)


def _closed(rows):
    """Half of the premises had all their listings taken down."""
    gone = F.col("property_id") % 2 == 0
    return rows.withColumns({
        "status": F.when(gone, "vanished").otherwise(F.col("status")),
        "vanished_at": F.when(gone, F.col("last_seen_at")).otherwise(F.col("vanished_at")),
    })


CLOSED_SQL = """lc AS (SELECT * EXCLUDE (status, vanished_at), CASE WHEN property_id % 2 = 0 THEN 'vanished' ELSE status END AS status,
  CASE WHEN property_id % 2 = 0 THEN last_seen_at ELSE vanished_at END AS vanished_at FROM lv)"""
BULK_SQL = f"""bulk AS (SELECT agency, source, count(*) AS n FROM lc WHERE status = 'vanished' AND vanished_at >= {SQL_AS_OF} - INTERVAL 24 HOUR AND agency IS NOT NULL
  GROUP BY 1, 2 HAVING count(*) >= 8)"""
CAND_SQL = f"""sets AS (SELECT property_key, count(*) FILTER ({ACTIVE}) AS active, count(DISTINCT source) AS tracked, count(DISTINCT source) FILTER (status = 'vanished') AS gone FROM lc GROUP BY 1),
rep AS (SELECT * FROM lc WHERE status = 'vanished' QUALIFY row_number() OVER (PARTITION BY property_key ORDER BY vanished_at DESC, last_seen_at DESC, source DESC, external_id DESC) = 1),
cand AS (
  SELECT r.property_key, r.source, r.external_id, r.deal_type, r.vanished_at, r.first_seen_at, r.price AS last_price, p.old_price AS previous_price, r.price_drop_count,
    s.gone, s.tracked, coalesce(r.source_status_raw IN ('sold', 'rented'), false) AS explicit, b.n IS NOT NULL AS bulk,
    EXISTS (SELECT 1 FROM pe WHERE pe.property_key = r.property_key AND event_type = 'relisted' AND occurred_at >= {SQL_AS_OF} - INTERVAL 14 DAY) AS back,
    CASE r.source_status_raw WHEN 'sold' THEN 'sold_marked' WHEN 'rented' THEN 'rented_marked' ELSE 'vanished' END AS new_status
  FROM rep r JOIN sets s ON s.property_key = r.property_key AND s.active = 0 LEFT JOIN pc p ON p.source = r.source AND p.external_id = r.external_id
  LEFT JOIN bulk b ON b.agency = r.agency AND b.source = r.source)"""
SCORE_SQL = """sc0 AS (SELECT *, abs(epoch_us(vanished_at) - epoch_us(first_seen_at)) / 86400000000.0 AS days FROM cand),
sc AS (SELECT *, CASE WHEN score >= 70 THEN 'likely_deal' WHEN score >= 40 THEN 'ambiguous' ELSE 'likely_withdrawn' END AS bucket FROM (
  SELECT *, greatest(0, least(100, CASE WHEN explicit THEN 25 ELSE 0 END + CASE WHEN tracked >= 2 AND gone >= tracked THEN 45 WHEN gone >= 2 THEN 25 ELSE 10 END
    + CASE WHEN price_drop_count > 0 OR coalesce(last_price < previous_price, false) THEN 15 ELSE 0 END
    + CASE WHEN days BETWEEN CASE deal_type WHEN 'rent' THEN 7 ELSE 14 END AND CASE deal_type WHEN 'rent' THEN 90 ELSE 180 END THEN 10 ELSE 0 END
    - CASE WHEN days < 3 THEN 30 ELSE 0 END - CASE WHEN bulk THEN 15 ELSE 0 END - CASE WHEN back THEN 35 ELSE 0 END)) AS score FROM sc0)),
hyp AS (SELECT property_key, source, external_id, score, bucket, vanished_at AS created_at, new_status, deal_type FROM sc)"""
ALL = (LV, EVENTS_SQL, CLOSED_SQL, BULK_SQL, CAND_SQL, SCORE_SQL)
# The same hypotheses for the mart of the observation log, where the district stands for the agency.
LOG_HYPOTHESES = (
    MART, "lc AS (SELECT *, district AS agency FROM ls)", "pe AS (SELECT property_key, event_type, occurred_at FROM ev)",
    "pc AS (SELECT source, external_id, arg_max(old_price, occurred_at) AS old_price FROM ev WHERE event_type = 'price_changed' GROUP BY 1, 2)",
    BULK_SQL.replace(SQL_AS_OF, SQL_LOG_AS_OF), CAND_SQL.replace(SQL_AS_OF, SQL_LOG_AS_OF), SCORE_SQL)


def _data(spark, root):
    base = listing_view(spark, root)
    return _closed(base), _events(base)


def _scored(spark, root):
    rows, events = _data(spark, root)
    return rows, D.rescore_all(rows, events, as_of(LISTINGS_AS_OF))


def _hyps(spark, root):
    rows, scored = _scored(spark, root)
    return rows, stored(scored, "scored").select(
        "property_key", *KEY, "score", "bucket", "features", F.lit(None).cast("string").alias("human_label"),
        F.col("vanished_at").alias("created_at"), F.col("vanished_at").alias("updated_at"))


# --- the vanish pass over the versioned mart --------------------------------------------------------

_VANISHED: dict = {}
MART_VANISH_SQL = (
    LV, SEEN_SQL, MISSING_SQL, MARKED_SQL, PROPERTY_EVENTS, VANISH_SQL, EVENTS_SQL.split("\n")[-1], "lc AS (SELECT * FROM marked)", BULK_SQL,
    CAND_SQL.replace("sets AS", "dsets AS").replace("JOIN sets s", "JOIN dsets s").replace("rep AS", "drep AS").replace("FROM rep r", "FROM drep r")[:-1]
    + " WHERE r.property_key IN (SELECT property_key FROM fresh))", SCORE_SQL)


def _vanish_mart(spark, root):
    """Listings, premises and events committed as one batch, the vanish pass as the next."""
    key = f"vanish {spark.sparkContext.applicationId} {root}"
    if key not in _VANISHED:
        rows, seen = _listings_seen(spark, root)
        mart = mart_tables(spark, scratch(spark, "vanish-mart"), parts=8)
        premises = rows.groupBy(F.col("property_key").alias("fingerprint")).agg(F.bool_or(F.expr(ACTIVE)).alias("is_active"))
        logged = _events(rows)
        payload = F.col("payload")
        logged = logged.withColumn("payload", S._payload(old_price=payload.old_price, new_price=payload.new_price))
        mart.commit(0, {"listings": (conform(rows, "listings"), range(8)), "properties": (conform(premises, "properties"), range(8))}, {"events": conform(logged, "events")})
        vanish_crawl(mart, 1, seen, as_of(LISTINGS_AS_OF), GUARD_CFG)
        _VANISHED[key] = mart
    return _VANISHED[key]


@query("mart_vanish_listings", with_(*MART_VANISH_SQL, body=f"""SELECT m.source, m.external_id, coalesce(s.new_status, m.status) AS status, strftime(m.vanished_at, '%Y-%m-%d %H:%M:%S') AS vanished_at
FROM marked m LEFT JOIN hyp s ON s.source = m.source AND s.external_id = m.external_id"""))
def mart_vanish_listings(spark, root):
    return _vanish_mart(spark, root).read("listings").select(*KEY, "status", stamp("vanished_at"))


@query("mart_vanish_hypotheses", with_(*MART_VANISH_SQL, body=f"SELECT property_key, source, external_id, score, bucket, strftime({SQL_AS_OF}, '%Y-%m-%d %H:%M:%S') AS created_at FROM hyp"))
def mart_vanish_hypotheses(spark, root):
    return _vanish_mart(spark, root).read("hypotheses").select("property_key", *KEY, "score", "bucket", stamp("created_at"))


@query("mart_vanish_premises", with_(*MART_VANISH_SQL, body=f"""SELECT property_key, bool_or({ACTIVE}) AS is_active, property_key IN (SELECT property_key FROM fresh) AS told FROM marked GROUP BY 1"""))
def mart_vanish_premises(spark, root):
    mart = _vanish_mart(spark, root)
    told = mart.read("events").where((F.col("event_type") == "vanished") & (F.col("payload.level") == "property")).select(F.col("property_key").alias("fingerprint"), F.lit(True).alias("told"))
    rows = mart.read("properties").join(told, "fingerprint", "left")
    return rows.select(F.col("fingerprint").alias("property_key"), "is_active", F.coalesce("told", F.lit(False)).alias("told"))


@query("agency_bulk_delist", with_(LV, CLOSED_SQL, BULK_SQL.replace("INTERVAL 24 HOUR", "INTERVAL 2400 HOUR"), body="SELECT * FROM bulk"))
def bulk(spark, root):
    from lotlens.config import MarketConfig

    rows, _ = _data(spark, root)
    return D.bulk_delist(rows, as_of(LISTINGS_AS_OF), MarketConfig(bulk_delist_hours=2400)).select("agency", "source", *big("n"))


@query("deal_candidates", with_(*ALL[:5], body="""SELECT property_key, source, external_id, deal_type, last_price, previous_price, gone AS vanished_on_sources, tracked AS tracked_sources_n,
  explicit AS explicit_sold_or_rented, bulk AS agency_bulk_delist, back AS relisted_soon, new_status FROM cand"""))
def candidates(spark, root):
    rows, events = _data(spark, root)
    return D.deal_candidates(rows, events, as_of(LISTINGS_AS_OF)).select(
        "property_key", *KEY, "deal_type", "last_price", "previous_price", *big("vanished_on_sources", "tracked_sources_n"),
        "explicit_sold_or_rented", "agency_bulk_delist", "relisted_soon", "new_status")


@query("deal_scores", with_(*ALL, body="SELECT property_key, source, external_id, score, bucket FROM sc"))
def scores(spark, root):
    return _scored(spark, root)[1].select("property_key", *KEY, "score", "bucket")


FEATURE_SQL = """SELECT code, count(*) AS n, CAST(sum(points) AS BIGINT) AS points FROM (
  SELECT 'explicit_status' AS code, 25 AS points FROM sc WHERE explicit
  UNION ALL SELECT CASE WHEN tracked >= 2 AND gone >= tracked THEN 'vanished_all_sources' WHEN gone >= 2 THEN 'vanished_multi_source' ELSE 'vanished_single_source' END,
    CASE WHEN tracked >= 2 AND gone >= tracked THEN 45 WHEN gone >= 2 THEN 25 ELSE 10 END FROM sc
  UNION ALL SELECT 'price_drop', 15 FROM sc WHERE price_drop_count > 0 OR last_price < previous_price
  UNION ALL SELECT 'typical_dom', 10 FROM sc WHERE days BETWEEN CASE deal_type WHEN 'rent' THEN 7 ELSE 14 END AND CASE deal_type WHEN 'rent' THEN 90 ELSE 180 END
  UNION ALL SELECT 'too_fast', -30 FROM sc WHERE days < 3
  UNION ALL SELECT 'agency_bulk', -15 FROM sc WHERE bulk
  UNION ALL SELECT 'relisted', -35 FROM sc WHERE back) GROUP BY code"""


@query("deal_feature_totals", with_(*ALL, body=FEATURE_SQL))
def feature_totals(spark, root):
    rows = _scored(spark, root)[1].select(F.inline("features"))
    return rows.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.sum("points").cast("bigint").alias("points"))


@query("deal_marks_on_listings", with_(*ALL, body="""SELECT l.source, coalesce(h.new_status, l.status) AS status, count(*) AS n FROM lc l
LEFT JOIN hyp h ON h.source = l.source AND h.external_id = l.external_id AND h.new_status <> 'vanished' GROUP BY 1, 2"""))
def deal_marks(spark, root):
    rows, scored = _scored(spark, root)
    return D.apply_deal_marks(rows, scored).groupBy("source", "status").agg(F.count(F.lit(1)).alias("n"))


# Stored hypotheses: every third premises has an older one; a third of those carry a label.
OLD_SQL = """old AS (SELECT property_key, source, external_id, 5 AS score, 'likely_withdrawn' AS bucket, CASE WHEN CAST(property_key AS BIGINT) % 9 = 0 THEN 'deal' END AS human_label,
  created_at - INTERVAL 10 DAY AS created_at FROM hyp WHERE CAST(property_key AS BIGINT) % 3 = 0)"""


def _old(hyps):
    key = F.col("property_key").cast("bigint")
    return hyps.where(key % 3 == 0).withColumns({
        "score": F.lit(5), "bucket": F.lit("likely_withdrawn"), "human_label": F.when(key % 9 == 0, "deal"),
        "created_at": F.col("created_at") - F.expr("INTERVAL 10 DAYS"),
    })


@query("hypotheses_merged", with_(*ALL, OLD_SQL, body=f"""SELECT o.property_key, CASE WHEN o.human_label IS NULL THEN h.score ELSE o.score END AS score,
  CASE WHEN o.human_label IS NULL THEN h.bucket ELSE o.bucket END AS bucket, o.human_label, strftime(o.created_at, '%Y-%m-%d %H:%M:%S') AS created_at
  FROM old o JOIN hyp h ON h.property_key = o.property_key
UNION ALL SELECT h.property_key, h.score, h.bucket, NULL, strftime({SQL_AS_OF}, '%Y-%m-%d %H:%M:%S') FROM hyp h
  WHERE h.property_key NOT IN (SELECT property_key FROM old WHERE human_label IS NULL)"""))
def hypotheses_merged(spark, root):
    _, hyps = _hyps(spark, root)
    merged = D.merge_hypotheses(_old(hyps), hyps, as_of(LISTINGS_AS_OF))
    return merged.select("property_key", "score", "bucket", "human_label", stamp("created_at"))


@query("latest_hypothesis", with_(*ALL, OLD_SQL, body="""SELECT property_key, score, bucket FROM (SELECT property_key, score, bucket, created_at FROM hyp UNION ALL SELECT property_key, score, bucket, created_at FROM old)
QUALIFY row_number() OVER (PARTITION BY property_key ORDER BY created_at DESC, score DESC) = 1"""))
def latest_hypothesis(spark, root):
    _, hyps = _hyps(spark, root)
    return D.latest_hypothesis(hyps.unionByName(_old(hyps))).select("property_key", "score", "bucket")


@query("hypotheses_labelled", with_(*ALL, body="""SELECT property_key, score, CASE CAST(property_key AS BIGINT) % 5 WHEN 0 THEN 'deal' WHEN 1 THEN 'withdrawn' END AS human_label FROM hyp"""))
def hypotheses_labelled(spark, root):
    _, hyps = _hyps(spark, root)
    key = F.col("property_key").cast("bigint") % 5
    labels = hyps.select("property_key", "created_at", F.when(key == 0, "deal").when(key == 1, "withdrawn").when(key == 2, "no such label").alias("human_label"))
    return D.apply_labels(hyps, labels.where(F.col("human_label").isNotNull())).select("property_key", "score", "human_label")


@query("deal_bucket_counts", with_(*ALL, body=f"""SELECT bucket, n FROM (SELECT unnest(['likely_deal', 'ambiguous', 'likely_withdrawn', 'all']) AS bucket,
  unnest([count(*) FILTER (bucket = 'likely_deal'), count(*) FILTER (bucket = 'ambiguous'), count(*) FILTER (bucket = 'likely_withdrawn'), count(*)]) AS n
  FROM hyp WHERE deal_type = 'sale' AND created_at >= {SQL_AS_OF} - INTERVAL 8760 HOUR)"""))
def deal_bucket_counts(spark, root):
    rows, hyps = _hyps(spark, root)
    return D.bucket_counts(hyps, rows, "sale", as_of(LISTINGS_AS_OF), 8760)


@query("top_deals", with_(*ALL, body="""SELECT property_key, score, strftime(h.created_at, '%Y-%m-%d %H:%M:%S') AS created_at FROM hyp h WHERE deal_type = 'sale' AND bucket = 'likely_deal'
ORDER BY score DESC, h.created_at DESC, property_key LIMIT 50"""))
def top_deals(spark, root):
    rows, hyps = _hyps(spark, root)
    return D.top_deals(hyps, rows, "sale", as_of(LISTINGS_AS_OF), hours=None, limit=50).select("property_key", "score", stamp("created_at"))


@query("hypotheses_of_sales", with_(*ALL, body="SELECT property_key, source, external_id, score, deal_type FROM hyp WHERE deal_type = 'sale'"))
def hypotheses_for(spark, root):
    rows, hyps = _hyps(spark, root)
    return D.hypotheses_for(hyps, rows, "sale").select("property_key", *KEY, "score", "deal_type")


# Every fourth hypothesis lost its listing and falls back to the last seen one of its premises.
@query("deal_cards", with_(*ALL, body="""SELECT h.property_key, h.score, CASE WHEN CAST(h.property_key AS BIGINT) % 4 = 0 THEN f.external_id ELSE h.external_id END AS listing,
  h.property_key AS premises FROM hyp h JOIN (SELECT * FROM lc QUALIFY row_number() OVER (PARTITION BY property_key ORDER BY last_seen_at DESC, source DESC, external_id DESC) = 1) f
  ON f.property_key = h.property_key"""))
def deal_cards(spark, root):
    rows, hyps = _hyps(spark, root)
    lost = F.col("property_key").cast("bigint") % 4 == 0
    hyps = hyps.withColumn("external_id", F.when(lost, "none").otherwise(F.col("external_id")))
    premises = rows.select(F.col("property_key").alias("fingerprint")).distinct()
    return D.deal_cards(hyps, premises, rows).select(
        "property_key", "score", F.col("listing.external_id").alias("listing"), F.col("property.fingerprint").alias("premises"))


@query("activity_summary", with_(*ALL, body=f"""SELECT 8760 AS hours,
  (SELECT count(*) FROM lc WHERE deal_type = 'sale' AND first_seen_at >= {SQL_AS_OF} - INTERVAL 8760 HOUR) AS new_listings,
  (SELECT count(*) FROM (SELECT property_key FROM lc WHERE status = 'vanished' AND vanished_at >= {SQL_AS_OF} - INTERVAL 8760 HOUR GROUP BY 1) v WHERE CAST(property_key AS BIGINT) % 4 < 2) AS vanished,
  (SELECT count(*) FROM lc WHERE deal_type = 'sale' AND listing_id % 10 = 4 AND last_seen_at >= {SQL_AS_OF} - INTERVAL 8760 HOUR) AS relisted,
  (SELECT count(*) FROM pc JOIN lc USING (source, external_id) WHERE deal_type = 'sale' AND first_seen_at >= {SQL_AS_OF} - INTERVAL 8760 HOUR) AS price_drops,
  (SELECT count(*) FROM lc LEFT JOIN hyp h ON h.source = lc.source AND h.external_id = lc.external_id WHERE lc.deal_type = 'sale' AND h.new_status = 'sold_marked' AND last_seen_at >= {SQL_AS_OF} - INTERVAL 8760 HOUR) AS sold_or_rented,
  (SELECT count(*) FROM hyp WHERE deal_type = 'sale' AND bucket = 'likely_deal' AND created_at >= {SQL_AS_OF} - INTERVAL 8760 HOUR) AS likely_deals"""))
def activity_summary(spark, root):
    from lotlens.operators.activity import activity_summary as summary

    rows, events = _data(spark, root)
    rows, events = stored(rows, "listings"), stored(events, "events")
    scored = stored(D.rescore_all(rows, events, as_of(LISTINGS_AS_OF)), "scored")
    listings = D.apply_deal_marks(rows, scored).withColumn("updated_at", F.col("last_seen_at"))
    def event(kind, at, df):
        return df.select(*KEY, "property_key", F.lit(kind).alias("event_type"), F.col(at).alias("occurred_at"))

    log = event("appeared", "first_seen_at", rows).unionByName(
        event("vanished", "vanished_at", rows.where(F.col("status") == "vanished"))).unionByName(
        event("relisted", "last_seen_at", rows.where(F.col("listing_id") % 10 == 4))).unionByName(
        events.where(F.col("event_type") == "price_changed").select(*KEY, "property_key", "event_type", "occurred_at", "payload"),
        allowMissingColumns=True)
    premises = rows.select("property_key", F.when(F.col("property_id") % 4 < 2, "sale").otherwise("rent").alias("deal_type")).distinct()
    hyps = scored.withColumn("created_at", F.col("vanished_at"))
    out = summary(log, listings, premises, hyps, as_of(LISTINGS_AS_OF), 8760, "sale")
    return out.select("hours", *big("new_listings", "vanished", "relisted", "price_drops", "sold_or_rented", "likely_deals"))
