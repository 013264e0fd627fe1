"""Catalog search, lookups, annotation, audits and maintenance over the listing view."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotlens.config import SORT_MODES
from lotlens.functions.money import null_bad_price
from lotlens.functions.text import map_status, phone_digits
from lotlens.operators import changes as C
from lotlens.operators import market as M
from lotlens.operators import quality as Q
from lotlens.operators import search as X
from lotlens.operators import state as S
from lotlens.operators.ingest import mart_tables
from lotlens.operators.relational import page
from lotlens.plans.check_sql import (
    ACTIVE, COHORTS, LISTINGS_AS_OF as SQL_AS_OF, LOG_AS_OF as SQL_LOG_AS_OF, LV, MARKET, MART, MK, rnd, usd, with_,
)
from lotlens.plans.deal_queries import LOG_HYPOTHESES
from lotlens.plans.market_queries import HINT, HINT_COLUMNS, RATES, REF, _market
from lotlens.plans.mart import log_mart
from lotlens.plans.registry import big, query, stamp
from lotlens.plans.views import LISTINGS_AS_OF, as_of, listing_view, market_view, table
from lotlens.schemas import EXTRA
from lotlens.session import scratch, stored
from lotlens.sources.tables import conform

KEY = C.KEY


def _now():
    return as_of(LISTINGS_AS_OF)


def _with_extra(rows, **fields):
    """Listing view rows with a raw_extra struct; fields not given are null."""
    names = [p.strip().split(" ", 1) for p in EXTRA[len("STRUCT<"):-1].split(", ")]
    return rows.withColumn("raw_extra", F.struct(*[fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in names]))


@query("listings_page", with_(LV, body=f"SELECT listing_id, source, deal_type FROM lv WHERE status = 'active' AND source = '1-URGENT' AND deal_type = 'sale' ORDER BY last_seen_at DESC, source, external_id LIMIT 50 OFFSET 50"))
def listings_page(spark, root):
    return X.list_listings(listing_view(spark, root), "active", "1-URGENT", "sale", 50, 50).select("listing_id", "source", "deal_type")


@query("premises_page", with_(MART, body="SELECT property_key, deal_type, is_active FROM pr WHERE is_active AND deal_type = 'rent' ORDER BY last_seen_at DESC, property_key LIMIT 50"))
def premises_page(spark, root):
    return X.list_properties(log_mart(spark, root)["properties"], True, "rent").select("property_key", "deal_type", "is_active")


@query("catalog_base_modes", with_(LV, body=f"""SELECT 'catalog' AS mode, count(*) AS n FROM lv WHERE {ACTIVE} AND price IS NOT NULL AND deal_type = 'sale'
UNION ALL SELECT 'vanished', count(*) FROM lv WHERE deal_type = 'sale' UNION ALL SELECT 'price_drop', count(*) FROM lv WHERE deal_type = 'sale' AND status IN ('active', 'relisted', 'vanished')"""))
def catalog_base(spark, root):
    rows = listing_view(spark, root)
    out = None
    for mode in (None, "vanished", "price_drop"):
        one = X.catalog_base(rows, "sale", mode).agg(F.lit(mode or "catalog").alias("mode"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("text_search", with_(LV, body="SELECT listing_id FROM lv WHERE title ILIKE '%customer#0000000%' OR address_raw ILIKE '%customer#0000000%' OR district ILIKE '%customer#0000000%' OR city ILIKE '%customer#0000000%'"))
def text_search(spark, root):
    return X.text_search(listing_view(spark, root), " CUSTOMER#0000000 ").select("listing_id")


@query("district_filter", with_(LV, body="SELECT listing_id, district FROM lv WHERE district ILIKE '%nation_1%' OR district ILIKE '%nation_20%'"))
def district_filter(spark, root):
    return X.district_filter(listing_view(spark, root), "NATION_1", (("NATION_1", "nation_20"),)).select("listing_id", "district")


@query("period_filter", with_(LV, body="SELECT listing_id FROM lv WHERE first_seen_at >= TIMESTAMP '2000-01-08 00:00:00' - INTERVAL 168 HOUR"))
def period_filter(spark, root):
    return X.period_filter(listing_view(spark, root), "7d", as_of("2000-01-08 00:00:00")).select("listing_id")


@query("range_filter", with_(LV, body=f"SELECT listing_id FROM lv WHERE {usd('price', 'currency')} BETWEEN 3000 AND 200000 AND area_sqm BETWEEN 50 AND 150"))
def range_filter(spark, root):
    return X.range_filter(listing_view(spark, root), 200_000, 3_000, 50, 150).select("listing_id")


@query("active_and_excluded", with_(LV, body=f"""SELECT count(*) FILTER ({ACTIVE}) AS active, count(*) FILTER ({ACTIVE} AND exclude_from_stats) AS active_excluded,
count(*) FILTER ({ACTIVE} AND NOT exclude_from_stats) AS active_counted FROM lv"""))
def active_and_excluded(spark, root):
    rows = M.active(listing_view(spark, root)).withColumn("k", F.lit("active"))
    parts = rows.unionByName(M.excluded_only(rows).withColumn("k", F.lit("out"))).unionByName(M.for_stats(rows).withColumn("k", F.lit("in")))
    n = lambda k: F.count_if(F.col("k") == k)
    return parts.agg(n("active").alias("active"), n("out").alias("active_excluded"), n("in").alias("active_counted"))


@query("bad_prices_nulled", with_(LV, body="SELECT listing_id, CASE WHEN price * 2000 - 30000000 > 0 AND price * 2000 - 30000000 <= 500000000 THEN price * 2000 - 30000000 END AS price FROM lv"))
def bad_prices(spark, root):
    return listing_view(spark, root).select("listing_id", null_bad_price(F.col("price") * 2000 - 30_000_000).alias("price"))


SORT_SQL = {
    "newest": ("first_seen_at", "DESC"), "oldest": ("first_seen_at", "ASC"), "price_asc": (usd("price", "currency"), "ASC"),
    "price_desc": (usd("price", "currency"), "DESC"), "area_asc": ("area_sqm", "ASC"), "area_desc": ("area_sqm", "DESC"),
    "psm_asc": ("rate_usd", "ASC"), "psm_desc": ("rate_usd", "DESC"),
    "dom_asc": ("date_diff('day', first_seen_at, as_of)", "ASC"), "dom_desc": ("date_diff('day', first_seen_at, as_of)", "DESC"),
}


@query("first_page_of_each_sort", with_(LV, RATES, body="\nUNION ALL\n".join(
    f"(SELECT '{mode}' AS mode, listing_id FROM (SELECT *, {SQL_AS_OF} AS as_of FROM rates) WHERE deal_type = 'sale' ORDER BY {key} {way} NULLS LAST, source, external_id LIMIT 50)"
    for mode, (key, way) in SORT_SQL.items())))
def sorted_pages(spark, root):
    rows = listing_view(spark, root).where(F.col("deal_type") == "sale")
    return X.first_pages(rows, SORT_MODES, _now(), 50).select("mode", "listing_id")


@query("last_page_clamped", with_(LV, body="""SELECT listing_id FROM (SELECT listing_id, row_number() OVER (ORDER BY listing_id) AS rn, count(*) OVER () AS total FROM lv WHERE deal_type = 'rent')
WHERE rn > (greatest(1, CAST(ceil(total / 50.0) AS BIGINT)) - 1) * 50"""))
def last_page(spark, root):
    rows = listing_view(spark, root).where(F.col("deal_type") == "rent")
    return page(rows, [F.col("listing_id")], 10**6, 50).select("listing_id")


@query("facets", with_(LV, body="""SELECT 'segment' AS facet, property_type AS value, count(*) AS n FROM lv WHERE deal_type = 'sale' GROUP BY 2
UNION ALL SELECT 'source', source, count(*) FROM lv WHERE deal_type = 'sale' GROUP BY 2"""))
def facets(spark, root):
    return X.facets(listing_view(spark, root), "sale")


# --- lookups --------------------------------------------------------------------------------------

PHONES = """ph AS (SELECT right(regexp_replace(phone, '[^0-9]', '', 'g'), 10) AS phone_digits, count(*) AS phone_listings FROM lv WHERE phone IS NOT NULL GROUP BY 1)"""


@query("phone_frequency", with_(LV, PHONES, body="SELECT phone_digits, phone_listings FROM ph"))
def phone_frequency(spark, root):
    return X.phone_frequency(listing_view(spark, root))


SELLER_SQL = """sel AS (SELECT lv.listing_id, coalesce(ph.phone_listings, 1) AS phone_listings, CASE WHEN coalesce(agency, '') <> '' THEN 'agency'
  WHEN coalesce(ph.phone_listings, 1) >= 3 THEN 'agency' WHEN phone IS NOT NULL AND coalesce(ph.phone_listings, 1) = 1 THEN 'owner' ELSE 'unknown' END AS seller
  FROM lv LEFT JOIN ph ON ph.phone_digits = right(regexp_replace(lv.phone, '[^0-9]', '', 'g'), 10))"""


@query("phone_counts", with_(LV, PHONES, SELLER_SQL, body="SELECT listing_id, phone_listings FROM sel"))
def phone_counts(spark, root):
    return X.with_phone_count(listing_view(spark, root)).select("listing_id", *big("phone_listings"))


@query("sellers", with_(LV, PHONES, SELLER_SQL, body="SELECT listing_id, seller FROM sel"))
def sellers(spark, root):
    return X.with_seller(listing_view(spark, root)).select("listing_id", "seller")


@query("portal_counts", with_(LV, body="SELECT property_key, count(*) AS portals FROM lv GROUP BY 1"))
def portal_counts(spark, root):
    return X.portal_counts(listing_view(spark, root))


SPREAD = f"""sp0 AS (SELECT property_key, count(*) AS n, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, count(u) AS good, min(u) AS low, max(u) AS high
  FROM (SELECT *, {usd('price', 'currency')} AS u FROM lv WHERE {ACTIVE} AND price IS NOT NULL) GROUP BY 1 HAVING count(*) >= 2),
spread AS (SELECT property_key, n, sources, CASE WHEN good >= 2 THEN round(low) END AS price_min_usd, CASE WHEN good >= 2 THEN round(high) END AS price_max_usd,
  CASE WHEN good >= 2 THEN {rnd('(high - low) / low * 100', 1)} END AS spread_pct FROM sp0)"""


@query("portal_spreads", with_(LV, SPREAD, body="SELECT * FROM spread"))
def portal_spreads(spark, root):
    return X.portal_spreads(listing_view(spark, root)).withColumn("sources", F.array_join("sources", ","))


PORTALS = """pt AS (SELECT l.listing_id, c.portals, s.sources AS portal_sources, s.spread_pct AS portal_spread_pct FROM lv l
  JOIN (SELECT property_key, count(*) AS portals FROM lv GROUP BY 1) c ON c.property_key = l.property_key LEFT JOIN spread s ON s.property_key = l.property_key)"""


@query("listings_with_portals", with_(LV, SPREAD, PORTALS, body="SELECT * FROM pt"))
def with_portals(spark, root):
    return X.with_portals(listing_view(spark, root)).select(
        "listing_id", *big("portals"), F.array_join("portal_sources", ",").alias("portal_sources"), "portal_spread_pct")


@query("source_sets", with_(LV, body=f"""SELECT property_key, count(*) FILTER ({ACTIVE}) AS active_listings, array_to_string(list_sort(list(DISTINCT source)), ',') AS tracked,
coalesce(array_to_string(list_sort(list(DISTINCT source) FILTER (status = 'vanished')), ','), '') AS gone FROM lv GROUP BY 1"""))
def source_sets(spark, root):
    return S.source_sets(listing_view(spark, root)).select(
        "property_key", *big("active_listings"), F.array_join("tracked_sources", ",").alias("tracked"), F.array_join("vanished_sources", ",").alias("gone"))


@query("gone_from_every_source", with_(LV, body="SELECT property_key FROM lv GROUP BY 1 HAVING count(DISTINCT source) = count(DISTINCT source) FILTER (status = 'vanished')"))
def gone_everywhere(spark, root):
    return S.gone_everywhere(S.source_sets(listing_view(spark, root))).select("property_key")


@query("premises_with_vanished", with_(LV, body="SELECT DISTINCT property_key FROM lv WHERE status = 'vanished'"))
def premises_with_vanished(spark, root):
    return listing_view(spark, root).where(F.col("status") == "vanished").select("property_key").distinct()


@query("premises_active_flag", with_(LV, body=f"SELECT CAST(c_custkey AS VARCHAR) AS fingerprint, coalesce(a.live, false) AS is_active FROM customer LEFT JOIN (SELECT property_key, bool_or({ACTIVE}) AS live FROM lv GROUP BY 1) a ON a.property_key = CAST(c_custkey AS VARCHAR)"))
def active_flag(spark, root):
    premises = table(spark, root, "customer").select(F.col("c_custkey").cast("string").alias("fingerprint"))
    return S.refresh_active(premises, listing_view(spark, root)).select("fingerprint", "is_active")


@query("representative_listing", with_(LV, body="""SELECT property_key, source, external_id FROM lv WHERE status = 'vanished'
QUALIFY row_number() OVER (PARTITION BY property_key ORDER BY vanished_at DESC, last_seen_at DESC, source DESC, external_id DESC) = 1"""))
def representative(spark, root):
    from lotlens.operators.activity import representative as rep

    return rep(listing_view(spark, root)).select("property_key", *KEY)


@query("listings_of_dropped_ids", with_(MART, body=f"""SELECT source, external_id, status FROM ls WHERE (source, external_id) IN
(SELECT (source, external_id) FROM ev WHERE event_type = 'price_changed' AND new_price < old_price AND occurred_at >= {SQL_LOG_AS_OF} - INTERVAL 24 HOUR)"""))
def semi_ids(spark, root):
    from lotlens.operators.activity import price_drop_ids, since
    from lotlens.plans.views import LOG_AS_OF

    mart = log_mart(spark, root)
    return X.semi(mart["listings"], price_drop_ids(mart["events"], since(as_of(LOG_AS_OF), 24)), KEY).select(*KEY, "status")


@query("statuses_mapped", with_(LV, body="""SELECT listing_id, CASE source_status_raw WHEN 'sold' THEN 'sold_marked' WHEN 'rented' THEN 'rented_marked' WHEN 'inactive_404' THEN 'vanished' ELSE 'active' END AS mapped FROM lv"""))
def statuses_mapped(spark, root):
    return listing_view(spark, root).select("listing_id", map_status(F.col("source_status_raw")).alias("mapped"))


@query("days_on_market", with_(LV, body=f"SELECT listing_id, greatest(0, date_diff('day', first_seen_at, {SQL_AS_OF})) AS dom_days FROM lv"))
def days_on_market(spark, root):
    return listing_view(spark, root).select("listing_id", X.days_on_market(F.col("first_seen_at"), _now()).cast("bigint").alias("dom_days"))


@query("phone_digits", with_(LV, body="SELECT listing_id, CASE WHEN length(regexp_replace(phone, '[^0-9]', '', 'g')) >= 9 THEN right(regexp_replace(phone, '[^0-9]', '', 'g'), 10) END AS phone_digits FROM lv"))
def digits(spark, root):
    return listing_view(spark, root).select("listing_id", phone_digits(F.col("phone")).alias("phone_digits"))



@query("annotated_listings", with_(LV, MK, COHORTS, MARKET, REF, RATES, HINT, PHONES, SELLER_SQL, SPREAD, PORTALS, body=f"""SELECT h.listing_id, {HINT_COLUMNS}, h.ref_median_psm,
  sel.seller, pt.portals, pt.portal_spread_pct, greatest(0, date_diff('day', h.first_seen_at, {SQL_AS_OF})) AS dom_days, h.opex
FROM hint h JOIN sel ON sel.listing_id = h.listing_id JOIN pt ON pt.listing_id = h.listing_id"""))
def annotated(spark, root):
    rows = X.annotate(market_view(spark, root), _market(spark, root), _now())
    return rows.select("listing_id", "below_market", "discount_pct", "ref_median_psm", "seller", *big("portals"), "portal_spread_pct", *big("dom_days"), "opex")


# --- saved filters --------------------------------------------------------------------------------

WATCHES = [
    ("cheap sale", None, None, "sale", None, None, None, False, None, 60000.0),
    ("urgent office", None, "1-URGENT", "sale", "office", None, None, False, None, None),
    ("nation 3 rent", None, None, "rent", None, "NATION_3", None, False, 100.0, 4000.0),
    ("street 7", "street 7", None, None, None, None, None, False, None, None),
    ("fresh", None, None, None, None, None, "7d", False, None, None),
    ("below market", None, "2-HIGH", None, None, None, None, True, None, None),
    ("swapped", None, None, "sale", "retail", None, None, False, 90000.0, 50000.0),
]
WATCH_SQL = "wf(name, q, source, deal_type, segment, district, period, below_market, price_min, price_max) AS (VALUES " + ", ".join(
    "(" + ", ".join("NULL" if v is None else (f"'{v}'" if isinstance(v, str) else str(v)) for v in w) + ")" for w in WATCHES) + ")"


@query("saved_filter_matches", with_(LV, MK, COHORTS, MARKET, REF, RATES, HINT, WATCH_SQL, body=f"""SELECT w.name, l.source, l.external_id
FROM (SELECT *, coalesce(NOT exclude_from_stats AND share >= 0.12, false) AS bm, {usd('price', 'currency')} AS u FROM hint WHERE {ACTIVE} AND price IS NOT NULL) l JOIN wf w
ON (w.source IS NULL OR w.source = l.source) AND (w.deal_type IS NULL OR w.deal_type = l.deal_type) AND (w.segment IS NULL OR w.segment = l.property_type) AND (w.district IS NULL OR w.district = l.district)
AND (w.q IS NULL OR contains(lower(l.title), w.q) OR contains(lower(l.address_raw), w.q) OR contains(lower(l.district), w.q) OR contains(lower(l.city), w.q))
AND (w.period IS NULL OR l.first_seen_at >= {SQL_AS_OF} - INTERVAL 168 HOUR) AND (NOT w.below_market OR l.bm)
AND (w.price_min IS NULL OR u >= least(w.price_min, coalesce(w.price_max, w.price_min))) AND (w.price_max IS NULL OR u <= greatest(w.price_max, coalesce(w.price_min, w.price_max)))"""))
def saved_filters(spark, root):
    schema = ("name STRING, q STRING, source STRING, deal_type STRING, segment STRING, district STRING, period STRING, "
              "below_market BOOLEAN, price_min DOUBLE, price_max DOUBLE")
    rows = M.with_market_hint(M.active(market_view(spark, root)).where(F.col("price").isNotNull()), _market(spark, root))
    return X.match_watches(spark.createDataFrame(WATCHES, schema), rows, _now())


# One filter per customer: even ones search the name alone, odd ones a street of sales up to a price.
@query("saved_filters_by_text", with_(LV, body=f"""SELECT c_name AS name, source, external_id FROM (SELECT *, {usd('price', 'currency')} AS u FROM lv) l JOIN customer
ON CASE WHEN c_custkey % 2 = 0 THEN contains(lower(title), lower(c_name))
  ELSE deal_type = 'sale' AND u <= 500 + c_custkey AND contains(lower(address_raw), ' street ' || (c_custkey % 100)) END"""))
def saved_filters_by_text(spark, root):
    k, even = F.col("c_custkey"), F.col("c_custkey") % 2 == 0
    watches = table(spark, root, "customer").select(
        F.col("c_name").alias("name"), F.when(even, F.concat(F.lit(" "), F.upper("c_name"))).otherwise(F.concat(F.lit("street "), (k % 100).cast("string"))).alias("q"),
        F.lit("").alias("source"), F.when(~even, "sale").alias("deal_type"), *[F.lit(None).cast("string").alias(c) for c in ("segment", "district", "period")],
        F.lit(False).alias("below_market"), F.lit(None).cast("double").alias("price_min"), F.when(~even, 500.0 + k).alias("price_max"))
    return X.match_watches(watches, listing_view(spark, root).withColumn("below_market", F.lit(False)), _now(), index_from=1)


@query("premises_detail", with_(*LOG_HYPOTHESES, body="""SELECT property_key, 'listing' AS section, source, external_id, status AS label, strftime(last_seen_at, '%Y-%m-%d %H:%M:%S') AS at FROM ls
UNION ALL SELECT property_key, 'event', source, external_id, event_type, strftime(occurred_at, '%Y-%m-%d %H:%M:%S') FROM ev
UNION ALL SELECT property_key, 'hypothesis', source, external_id, bucket, strftime(created_at, '%Y-%m-%d %H:%M:%S') FROM hyp"""))
def premises_detail(spark, root):
    mart = log_mart(spark, root)
    rows = X.property_detail(mart["listings"], mart["events"], mart["hypotheses"])
    return rows.select("property_key", "section", *KEY, "label", stamp("at"))


# --- quality and maintenance ------------------------------------------------------------------------


@query("table_totals", with_(*LOG_HYPOTHESES, body=f"""SELECT 'total' AS grp, unnest(['listings', 'with_price', 'active', 'vanished']) AS name,
  unnest([count(*), count(price), count(*) FILTER (status = 'active'), count(*) FILTER (status = 'vanished')]) AS n FROM ls
UNION ALL SELECT 'total', 'properties', count(*) FROM pr UNION ALL SELECT 'total', 'events', count(*) FROM ev UNION ALL SELECT 'total', 'hypotheses', count(*) FROM hyp
UNION ALL SELECT 'source', source, count(*) FROM ls GROUP BY source UNION ALL SELECT 'segment', deal_type, count(*) FROM ls GROUP BY deal_type"""))
def table_totals(spark, root):
    mart = log_mart(spark, root)
    return Q.table_totals(mart["listings"].withColumn("property_type", F.col("deal_type")), mart["properties"], mart["hypotheses"], mart["events"])


AUDIT_ROWS = """au AS (SELECT *, CASE WHEN listing_id % 3 = 0 THEN 'domria' WHEN listing_id % 3 = 1 THEN 'rieltor' ELSE source END AS src,
  CASE WHEN listing_id % 5 = 0 THEN '17 17 250 000 $ ' || title ELSE title END AS ttl, 'https://dom.example/realty-' || CASE WHEN listing_id % 4 = 0 THEN 'lviv' ELSE 'kiev' END || '-' || listing_id AS lnk,
  deal_type = 'rent' AND listing_id % 7 = 0 AS flagged FROM rates)"""


def _audit_rows(spark, root):
    k = F.col("listing_id")
    rows = listing_view(spark, root).withColumns({
        "source": F.when(k % 3 == 0, "domria").when(k % 3 == 1, "rieltor").otherwise(F.col("source")),
        "title": F.when(k % 5 == 0, F.concat(F.lit("17 17 250 000 $ "), "title")).otherwise(F.col("title")),
        "url": F.concat(F.lit("https://dom.example/realty-"), F.when(k % 4 == 0, "lviv").otherwise("kiev"), F.lit("-"), k.cast("string")),
    })
    return _with_extra(rows, price_suspicious=F.when((F.col("deal_type") == "rent") & (k % 7 == 0), True), opex=F.col("opex"))


METRICS = ("active_listings", "sale_psm_out_of_band", "rent_psm_over_ceiling", "junk_titles", "rate_equals_total", "price_without_area", "out_of_region", "flagged_suspicious")


def audit_sql(rows: str) -> str:
    return f"""SELECT unnest([{', '.join(f"'{m}'" for m in METRICS)}]) AS metric,
unnest([count(*) FILTER ({ACTIVE}), count(*) FILTER ({ACTIVE} AND price IS NOT NULL AND area_sqm IS NOT NULL AND deal_type = 'sale' AND (rate_usd < 450 OR rate_usd > 10000)),
  count(*) FILTER ({ACTIVE} AND price IS NOT NULL AND area_sqm IS NOT NULL AND deal_type = 'rent' AND rate_usd > 70), count(*) FILTER ({ACTIVE} AND src = 'rieltor' AND ttl LIKE '17 17 %'),
  count(*) FILTER (area_sqm > 0 AND abs(price_per_sqm - price) / greatest(price, 1.0) < 0.02), count(*) FILTER ({ACTIVE} AND price IS NOT NULL AND area_sqm IS NULL),
  count(*) FILTER ({ACTIVE} AND src = 'domria' AND lnk LIKE '%lviv%'), count(*) FILTER (flagged)]) AS n FROM {rows}"""


@query("price_audit", with_(LV, RATES, AUDIT_ROWS, body=audit_sql("au")))
def price_audit(spark, root):
    return Q.price_audit(_audit_rows(spark, root))


@query("stats_exclusion", with_(LV, RATES, body="""SELECT listing_id, CASE WHEN listing_id % 6 IN (0, 1) THEN exclude_from_stats ELSE odd END AS excluded,
  CASE WHEN listing_id % 6 NOT IN (0, 1) AND odd THEN true END AS auto_excluded FROM (SELECT *, coalesce((deal_type = 'rent' AND rate_usd > 70) OR (deal_type = 'sale' AND (rate_usd < 450 OR rate_usd > 10000)), false) AS odd FROM rates)"""))
def stats_exclusion(spark, root):
    from lotlens.functions.money import suspicious_rate, with_effective_rate

    k = F.col("listing_id")
    rows = _with_extra(
        with_effective_rate(listing_view(spark, root)), stats_review_ok=F.when(k % 6 == 0, True), stats_exclude_manual=F.when(k % 6 == 1, True))
    flag, auto = S.apply_exclusion(suspicious_rate(F.col("rate_usd"), F.col("deal_type")), F.col("exclude_from_stats"), F.col("raw_extra"))
    return rows.select("listing_id", flag.alias("excluded"), auto.alias("auto_excluded"))


@query("manual_exclusion", with_(LV, body="""SELECT listing_id, CASE WHEN listing_id % 10 = 0 THEN listing_id % 20 = 0 ELSE exclude_from_stats END AS exclude_from_stats,
  CASE WHEN listing_id % 20 = 0 THEN true END AS manual, CASE WHEN listing_id % 20 = 10 THEN true END AS reviewed FROM lv"""))
def manual_exclusion(spark, root):
    rows = _with_extra(listing_view(spark, root))
    k = F.col("listing_id")
    decisions = rows.where(k % 10 == 0).select(*KEY, (k % 20 == 0).alias("exclude"))
    return S.set_exclusion(rows, decisions).select(
        "listing_id", "exclude_from_stats", F.col("raw_extra.stats_exclude_manual").alias("manual"), F.col("raw_extra.stats_review_ok").alias("reviewed"))


@query("exclusion_flags_migrated", with_(LV, body="SELECT listing_id, exclude_from_stats OR (deal_type = 'rent' AND listing_id % 7 = 0) AS exclude_from_stats FROM lv"))
def flags_migrated(spark, root):
    return Q.migrate_flags(_audit_rows(spark, root)).select("listing_id", "exclude_from_stats")


@query("refresh_worklist", with_(LV, RATES, body=f"""SELECT listing_id FROM rates WHERE {ACTIVE} AND price <> 0 AND area_sqm <> 0
AND ((deal_type = 'sale' AND rate_usd >= 10000) OR (deal_type = 'rent' AND rate_usd > 70)) ORDER BY source, external_id LIMIT 80"""))
def refresh_worklist(spark, root):
    return Q.refresh_worklist(listing_view(spark, root), 80).select("listing_id")


# A new batch: cards of four in five listings, every sixth with a new price; unseen ids on top.
@query("detail_worklist", with_(LV, body="""SELECT source, external_id, row_number() OVER (PARTITION BY source ORDER BY listing_id, external_id) AS rank FROM lv
WHERE listing_id % 5 <> 0 AND (listing_id % 7 = 0 OR (listing_id % 6 = 0 AND price IS NOT NULL) OR (phone IS NULL AND description IS NULL))
QUALIFY rank <= 80"""))
def detail_worklist(spark, root):
    rows = listing_view(spark, root)
    k = F.col("listing_id")
    batch = rows.where(k % 5 != 0).withColumns({"price": F.when(k % 6 == 0, F.col("price") - 1000).otherwise(F.col("price")), "seq": k})
    return Q.detail_worklist(batch, rows.where(k % 7 != 0), 80).select(*KEY, *big("rank"))


@query("batch_summary", with_(LV, body="""SELECT source, count(*) FILTER (listing_id % 5 <> 0) AS seen, count(*) FILTER (listing_id % 5 <> 0 AND price IS NOT NULL) AS with_price,
  count(*) FILTER (listing_id % 5 <> 0 AND property_type <> 'warehouse') AS upserted, count(*) FILTER (listing_id % 5 <> 0 AND property_type = 'warehouse') AS skipped_irrelevant,
  count(*) FILTER (listing_id % 5 <> 0 AND property_type <> 'warehouse' AND listing_id % 2 = 0) AS snapshots_skipped, count(*) FILTER (listing_id % 5 = 0 AND status IN ('active', 'relisted')) AS vanished
FROM lv GROUP BY source"""))
def batch_summary(spark, root):
    rows = listing_view(spark, root)
    k = F.col("listing_id")
    seen = rows.where(k % 5 != 0)
    relevant = seen.where(F.col("property_type") != "warehouse")
    marked = S.mark_vanished(rows, seen, _now() + F.expr("INTERVAL 4000 DAYS"))
    return Q.batch_summary(rows, seen, relevant, relevant.where(k % 2 == 1), marked)


JUNK = """jk AS (SELECT *, listing_id % 3 = 0 AND listing_id % 4 = 0 AS outside FROM lv)"""


def _mart(spark, rows):
    """The listings as a mart of one batch."""
    mart = mart_tables(spark, scratch(spark, "junk-mart"), parts=8)
    rows = stored(rows, "junk-rows")
    keyed = {
        "listings": rows, "properties": rows.select(F.col("property_key").alias("fingerprint")).distinct(),
        "hypotheses": rows.where(F.col("status") == "vanished").dropDuplicates(["property_key", *KEY]).select(*KEY, "property_key"),
    }
    events = rows.select(*KEY, "property_key", F.lit("appeared").alias("event_type"))
    appended = {"events": conform(events, "events"), "snapshots": conform(rows.select(*KEY, "price"), "snapshots")}
    mart.commit(0, {n: (conform(df, n), range(mart.parts)) for n, df in keyed.items()}, appended)
    return mart


def _counts(mart, removed, lost):
    out = None
    tables = {n: mart.read(n) for n in ("listings", "properties", "events", "snapshots", "hypotheses")}
    for name, df in {**tables, "removed": removed, "orphans": lost}.items():
        one = df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def counts_sql(gone: str) -> str:
    return f"""k AS (SELECT * FROM jk WHERE NOT {gone}), lost AS (SELECT DISTINCT property_key FROM jk WHERE property_key NOT IN (SELECT property_key FROM k))
SELECT 'listings' AS table_name, count(*) AS n FROM k UNION ALL SELECT 'properties', count(DISTINCT property_key) FROM k UNION ALL SELECT 'events', count(*) FROM k
UNION ALL SELECT 'snapshots', count(*) FROM k UNION ALL SELECT 'hypotheses', count(*) FROM k WHERE status = 'vanished'
UNION ALL SELECT 'removed', count(*) FROM jk WHERE {gone} UNION ALL SELECT 'orphans', count(*) FROM lost"""


@query("junk_cleaned", f"WITH {LV},\n{JUNK},\n" + counts_sql("outside"))
def junk_cleaned(spark, root):
    mart = _mart(spark, _audit_rows(spark, root))
    return _counts(mart, *Q.clean_junk(mart, 1))


@query("irrelevant_pruned", f"WITH {LV},\n{JUNK},\n" + counts_sql("(property_type = 'warehouse')"))
def irrelevant_pruned(spark, root):
    mart = _mart(spark, listing_view(spark, root))
    return _counts(mart, *Q.prune_irrelevant(mart, 1))


@query("orphan_premises", with_(LV, body="SELECT CAST(c_custkey AS VARCHAR) AS fingerprint FROM customer WHERE c_custkey NOT IN (SELECT property_id FROM lv WHERE status <> 'vanished')"))
def orphan_premises(spark, root):
    premises = table(spark, root, "customer").select(F.col("c_custkey").cast("string").alias("fingerprint"))
    return Q.orphans(premises, listing_view(spark, root).where(F.col("status") != "vanished"))


@query("opex_backfill", with_(LV, body="""SELECT CASE listing_id % 4 WHEN 1 THEN 'without' ELSE 'unknown' END AS opex_found, count(*) AS n,
  count(*) FILTER (CASE listing_id % 4 WHEN 1 THEN 'without' ELSE 'unknown' END <> opex) AS updated FROM lv WHERE deal_type = 'rent' GROUP BY 1"""))
def opex_backfill(spark, root):
    rows = _audit_rows(spark, root).withColumn("description", F.when(F.col("listing_id") % 4 == 1, "оренда без OPEX").otherwise("оренда"))
    return Q.opex_counts(Q.backfill_opex(rows))


