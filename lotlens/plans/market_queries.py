"""Market, price-rate and inventory queries over the listing view."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotlens.functions.money import (
    clean_currency, fix_rent_currency, implied_rate, implied_rate_usd, in_band, suspicious_rate, to_usd,
    with_effective_rate, with_sane_rate,
)
from lotlens.operators import market as M
from lotlens.operators.activity import seller_stress
from lotlens.plans.check_sql import (
    ACTIVE, COHORTS, INVENTORY, LV, MARKET, MART, MK, RENT_PICK, LOG_AS_OF as SQL_LOG_AS_OF, rnd, usd, with_,
)
from lotlens.plans.mart import log_mart
from lotlens.plans.registry import big, query
from lotlens.plans.views import LOG_AS_OF, as_of, listing_view, market_view
from lotlens.session import scratch
from lotlens.sources.tables import read_daily, upsert_daily

STATS = ["district", "avg_psm", "median_psm", "n"]


@query("market_sale_by_district", with_(LV, MK, COHORTS, MARKET, body=f"SELECT {', '.join(STATS)} FROM market WHERE cohort = 'sale'"))
def market_sale(spark, root):
    return M.market_stats(market_view(spark, root), "sale").select(*STATS)


@query("market_rent_without_opex", with_(LV, MK, COHORTS, MARKET, body=f"SELECT {', '.join(STATS)} FROM market WHERE cohort = 'rent_without_opex'"))
def market_rent(spark, root):
    return M.market_stats(market_view(spark, root), "rent", "without").select(*STATS)


@query("market_all_cohorts", with_(LV, MK, COHORTS, MARKET, body=f"SELECT cohort, {', '.join(STATS)} FROM market"))
def market_all(spark, root):
    return M.all_market_stats(market_view(spark, root)).select("cohort", *STATS)


def _market(spark, root):
    return M.stored(M.all_market_stats(market_view(spark, root)), "market")


@query("rent_slice_picked", with_(LV, MK, COHORTS, MARKET, RENT_PICK, body=f"SELECT cohort, {', '.join(STATS)} FROM pick"))
def rent_slice(spark, root):
    return M.pick_rent_slice(_market(spark, root)).select("cohort", *STATS)


YIELD = """SELECT s.district, s.median_psm AS sale_median_psm, r.median_psm AS rent_median_psm, s.n AS sale_n, r.n AS rent_n,
  round(r.median_psm * 12 / s.median_psm * 100, 1) AS yield_pct, round(100 / round(r.median_psm * 12 / s.median_psm * 100, 1), 1) AS payback_years
FROM market s JOIN pick r ON s.district IS NOT DISTINCT FROM r.district WHERE s.cohort = 'sale'"""


@query("gross_yield", with_(LV, MK, COHORTS, MARKET, RENT_PICK, body=YIELD))
def gross_yield(spark, root):
    return M.rough_yield(_market(spark, root))


COMPARE = """SELECT coalesce(s.district, r.district) AS district, s.avg_psm AS sale_avg, coalesce(s.n, 0) AS sale_n, r.avg_psm AS rent_avg,
  coalesce(r.n, 0) AS rent_n, s.median_psm AS sale_median, r.median_psm AS rent_median
FROM (SELECT * FROM market WHERE cohort = 'sale' AND district IS NOT NULL) s
FULL JOIN (SELECT * FROM pick WHERE district IS NOT NULL) r ON s.district = r.district"""


@query("sale_against_rent", with_(LV, MK, COHORTS, MARKET, RENT_PICK, body=COMPARE))
def sale_against_rent(spark, root):
    return M.compare_districts(_market(spark, root))


@query("active_inventory", with_(LV, INVENTORY, body="SELECT scope, district, sale, rent FROM inv"))
def inventory(spark, root):
    return M.active_inventory(market_view(spark, root)).select("scope", "district", *big("sale", "rent"))


STRESS = f"""sig AS (
  SELECT l.district, count(*) FILTER (e.event_type = 'vanished') AS vanished, count(*) FILTER (e.event_type = 'relisted') AS relisted,
    count(*) FILTER (e.event_type = 'price_changed' AND e.new_price < e.old_price) AS price_drops
  FROM ev e JOIN ls l ON e.source = l.source AND e.external_id = l.external_id
  WHERE e.occurred_at >= {SQL_LOG_AS_OF} - INTERVAL 7 DAY AND l.deal_type = 'sale' GROUP BY l.district),
stock AS (SELECT district, count(*) AS active FROM ls WHERE {ACTIVE} AND deal_type = 'sale' GROUP BY district),
stress AS (
  SELECT coalesce(s.district, k.district) AS district,
    CAST(greatest(0, least(100, round_even((coalesce(vanished, 0) * 40 + coalesce(relisted, 0) * 25 + coalesce(price_drops, 0) * 20) / greatest(coalesce(active, 0), 1) * 8, 0))) AS INTEGER) AS score,
    coalesce(vanished, 0) AS vanished, coalesce(relisted, 0) AS relisted, coalesce(price_drops, 0) AS price_drops, coalesce(active, 0) AS active
  FROM sig s FULL JOIN stock k ON s.district = k.district)"""


def _stress(spark, root):
    mart = log_mart(spark, root)
    rows = mart["listings"].withColumn("district_norm", F.col("district"))
    return seller_stress(mart["events"], rows, M.active_inventory(rows), as_of(LOG_AS_OF), 7, "sale")


@query("seller_stress", with_(MART, STRESS, body="SELECT * FROM stress"))
def stress(spark, root):
    return _stress(spark, root).select("district", "score", *big("vanished", "relisted", "price_drops", "active"))


REPORT = """SELECT coalesce(p.district, i.district, t.district) AS district, coalesce(i.sale, 0) AS active, p.avg_psm, p.median_psm,
  coalesce(p.n, 0) AS sample_n, t.score AS stress
FROM (SELECT * FROM market WHERE cohort = 'sale' AND district IS NOT NULL) p
FULL JOIN (SELECT * FROM inv WHERE scope = 'district') i ON p.district = i.district
FULL JOIN stress t ON coalesce(p.district, i.district) = t.district"""


@query("district_report", with_(LV, MK, COHORTS, MARKET, INVENTORY, MART, STRESS, body=REPORT))
def district_report(spark, root):
    stock = M.active_inventory(market_view(spark, root))
    rows = M.district_report(_market(spark, root), stock, _stress(spark, root), "sale")
    return rows.select("district", *big("active"), "avg_psm", "median_psm", *big("sample_n"), "stress")


SNAP = """side AS (
  SELECT coalesce(coalesce(i.k, s.k), r.k) AS k, s.median_psm AS sale_median, s.avg_psm AS sale_avg, coalesce(s.n, 0) AS sale_n,
    r.median_psm AS rent_median, r.avg_psm AS rent_avg, coalesce(r.n, 0) AS rent_n, coalesce(i.sale, 0) AS sale_active, coalesce(i.rent, 0) AS rent_active
  FROM (SELECT CASE scope WHEN 'total' THEN '*' ELSE district END AS k, sale, rent FROM inv WHERE scope <> 'no_district') i
  FULL JOIN (SELECT coalesce(district, '*') AS k, * FROM market WHERE cohort = 'sale') s ON i.k = s.k
  FULL JOIN (SELECT coalesce(district, '*') AS k, * FROM pick) r ON coalesce(i.k, s.k) = r.k)"""
POINT = ["sale_median", "sale_avg", "sale_n", "rent_median", "rent_avg", "rent_n", "sale_active", "rent_active"]


def _snapshot(spark, root):
    return M.market_snapshot(market_view(spark, root).withColumn("day", F.lit("2001-08-01").cast("date")))


@query("market_snapshot_city", with_(LV, MK, COHORTS, MARKET, RENT_PICK, INVENTORY, SNAP, body="""SELECT '2001-08-01' AS day, sale_median AS sale_median_psm, sale_avg AS sale_avg_psm, sale_n AS sale_sample_n,
  sale_active AS sale_active_n, rent_median AS rent_median_psm, rent_avg AS rent_avg_psm, rent_n AS rent_sample_n, rent_active AS rent_active_n FROM side WHERE k = '*'"""))
def snapshot_city(spark, root):
    return _snapshot(spark, root).select(
        F.col("day").cast("string").alias("day"), "sale_median_psm", "sale_avg_psm", *big("sale_sample_n", "sale_active_n"),
        "rent_median_psm", "rent_avg_psm", *big("rent_sample_n", "rent_active_n"))


@query("market_snapshot_districts", with_(LV, MK, COHORTS, MARKET, RENT_PICK, INVENTORY, SNAP, body=f"SELECT k AS district, {', '.join(POINT)} FROM side WHERE k <> '*'"))
def snapshot_districts(spark, root):
    return _snapshot(spark, root).select(F.inline("districts")).select("district", *POINT)


SERIES = f"""days AS (SELECT CAST(unnest(generate_series(date_trunc('month', (SELECT min(first_seen_at) FROM lv)) + INTERVAL 1 MONTH, date_trunc('month', (SELECT max(last_seen_at) FROM lv)), INTERVAL 1 MONTH)) AS TIMESTAMP) - INTERVAL 1 DAY AS day),
dl AS (SELECT day, deal_type, opex, {usd('price', 'currency')} / area_sqm AS psm, exclude_from_stats, (city = 'Kyiv' OR district IS NOT NULL) AS in_city
  FROM lv JOIN days ON first_seen_at <= day AND last_seen_at >= day WHERE {ACTIVE}),
sl AS (SELECT day, median(psm) AS m, avg(psm) AS a, count(*) AS n FROM dl WHERE NOT exclude_from_stats AND in_city AND deal_type = 'sale' AND psm BETWEEN 450 AND 10000 GROUP BY day),
rt AS (SELECT day, median(psm) AS m, avg(psm) AS a, count(*) AS n, median(psm) FILTER (opex = 'without') AS nm, avg(psm) FILTER (opex = 'without') AS na, count(*) FILTER (opex = 'without') AS nn
  FROM dl WHERE NOT exclude_from_stats AND in_city AND deal_type = 'rent' AND psm BETWEEN 3 AND 70 GROUP BY day),
st AS (SELECT day, count(*) FILTER (deal_type = 'sale') AS s, count(*) FILTER (deal_type = 'rent') AS r FROM dl GROUP BY day)
SELECT strftime(st.day, '%Y-%m-%d') AS day, round(sl.m, 1) AS sale_median_psm, round(sl.a, 1) AS sale_avg_psm, coalesce(sl.n, 0) AS sale_sample_n, st.s AS sale_active_n,
  round(CASE WHEN nn >= 15 THEN nm ELSE rt.m END, 1) AS rent_median_psm, round(CASE WHEN nn >= 15 THEN na ELSE rt.a END, 1) AS rent_avg_psm,
  coalesce(CASE WHEN nn >= 15 THEN nn ELSE rt.n END, 0) AS rent_sample_n, st.r AS rent_active_n
FROM st LEFT JOIN sl ON st.day = sl.day LEFT JOIN rt ON st.day = rt.day ORDER BY st.day DESC LIMIT 36"""


@query("market_daily_series", "WITH " + LV + ",\n" + SERIES)
def daily_series(spark, root):
    """Month-end snapshots written by day, read back and cut to the last 36."""
    rows = market_view(spark, root)
    ends = F.transform(
        F.sequence(F.trunc("first_seen_at", "month"), F.trunc("last_seen_at", "month"), F.expr("INTERVAL 1 MONTH")),
        lambda m: F.last_day(m))
    alive = F.filter(ends, lambda d: (d >= F.to_date("first_seen_at")) & (d <= F.to_date("last_seen_at")))
    path = scratch(spark, "daily")
    upsert_daily(M.market_snapshot(rows.withColumn("day", F.explode(alive))), path)
    return M.series(read_daily(spark, path), 36).select(
        F.col("day").cast("string").alias("day"), "sale_median_psm", "sale_avg_psm", "sale_sample_n", "sale_active_n",
        "rent_median_psm", "rent_avg_psm", "rent_sample_n", "rent_active_n")


REF = """ref AS (
  SELECT l.*, coalesce(d.median_psm, c.median_psm) AS ref_median_psm, l.chosen AS cohort FROM (
    SELECT lv.*, CASE WHEN deal_type = 'sale' THEN 'sale' WHEN opex = 'without' AND EXISTS (SELECT 1 FROM market WHERE cohort = 'rent_without_opex' AND district IS NULL) THEN 'rent_without_opex'
      WHEN opex = 'with' AND EXISTS (SELECT 1 FROM market WHERE cohort = 'rent_with_opex' AND district IS NULL) THEN 'rent_with_opex' ELSE 'rent' END AS chosen FROM lv) l
  LEFT JOIN market c ON c.cohort = l.chosen AND c.district IS NULL LEFT JOIN market d ON d.cohort = l.chosen AND d.district = l.district)"""


@query("market_reference", with_(LV, MK, COHORTS, MARKET, REF, body="SELECT listing_id, cohort, ref_median_psm FROM ref"))
def market_reference(spark, root):
    return M.with_market_reference(market_view(spark, root), _market(spark, root)).select("listing_id", "cohort", "ref_median_psm")


# Rate rules in SQL: repaired currency, implied and sane rate, effective USD rate.
RATES = f"""rt0 AS (
  SELECT *, CASE WHEN price > 0 AND area_sqm > 0 THEN {rnd('price / area_sqm', 4)} END AS implied FROM lv),
rt1 AS (
  SELECT *, {usd('implied', 'currency')} AS implied_usd,
    CASE WHEN deal_type = 'rent' AND price > 0 AND area_sqm > 0 AND currency = 'USD' AND implied > 70 AND implied / 44.61 BETWEEN 3 AND 70 THEN 'UAH' ELSE currency END AS cur2 FROM rt0),
rt2 AS (
  SELECT *, {usd('implied', 'cur2')} AS iu, {usd('price_per_sqm', 'cur2')} AS su, {usd('price_per_sqm', 'currency')} AS su0 FROM rt1),
rates AS (
  SELECT *, CASE WHEN implied IS NULL THEN price_per_sqm WHEN price_per_sqm IS NULL OR abs(price_per_sqm - price) / greatest(price, 1.0) < 0.02 THEN implied
      WHEN deal_type = 'rent' AND su0 > 70 AND implied_usd <= 70 THEN implied
      WHEN abs(su0 - implied_usd) / greatest(implied_usd, 0.5) > 0.35 THEN implied ELSE price_per_sqm END AS sane_rate,
    {usd('''(CASE WHEN implied IS NULL THEN price_per_sqm WHEN price_per_sqm IS NULL OR abs(price_per_sqm - price) / greatest(price, 1.0) < 0.02 THEN implied
      WHEN deal_type = 'rent' AND su > 70 AND iu <= 70 THEN implied
      WHEN abs(su - iu) / greatest(iu, 0.5) > 0.35 THEN implied ELSE price_per_sqm END)''', 'cur2')} AS rate_usd FROM rt2)"""


@query("usd_prices", with_(LV, body=f"SELECT listing_id, round({usd('price', 'currency')}, 2) AS price_usd FROM lv"))
def usd_prices(spark, root):
    rows = listing_view(spark, root)
    return rows.select("listing_id", F.round(to_usd(F.col("price"), F.col("currency")), 2).alias("price_usd"))


@query("implied_rates", with_(LV, RATES, body="SELECT listing_id, implied, implied_usd FROM rates"))
def implied_rates(spark, root):
    p, c, a = F.col("price"), F.col("currency"), F.col("area_sqm")
    return listing_view(spark, root).select(
        "listing_id", implied_rate(p, a).alias("implied"), implied_rate_usd(p, c, a).alias("implied_usd"),
    )


@query("rent_currency_repaired", with_(LV, RATES, body="SELECT listing_id, cur2 AS currency, cur2 <> currency AS repaired FROM rates"))
def rent_currency(spark, root):
    c = F.col
    fixed = fix_rent_currency(c("price"), c("currency"), c("area_sqm"), c("deal_type"))
    return listing_view(spark, root).select("listing_id", fixed.alias("currency"), (fixed != clean_currency(c("currency"))).alias("repaired"))


@query("sane_rates", with_(LV, RATES, body="SELECT listing_id, sane_rate FROM rates"))
def sane_rates(spark, root):
    return with_sane_rate(listing_view(spark, root), "sane_rate").select("listing_id", "sane_rate")


@query("effective_rates", with_(LV, RATES, body="SELECT listing_id, rate_usd FROM rates"))
def effective_rates(spark, root):
    return with_effective_rate(listing_view(spark, root)).select("listing_id", "rate_usd")


@query("suspicious_rates", with_(LV, RATES, body="""SELECT deal_type, count(*) AS n, count(*) FILTER ((deal_type = 'rent' AND rate_usd > 70) OR (deal_type = 'sale' AND (rate_usd < 450 OR rate_usd > 10000))) AS suspicious
FROM rates GROUP BY deal_type"""))
def suspicious_rates(spark, root):
    flag = suspicious_rate(F.col("rate_usd"), F.col("deal_type"))
    return with_effective_rate(listing_view(spark, root)).groupBy("deal_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(flag).alias("suspicious"))


@query("rates_in_band", with_(LV, body=f"""SELECT listing_id, psm AS psm_usd FROM (SELECT *, {usd('price', 'currency')} / area_sqm AS psm FROM lv)
WHERE (deal_type = 'sale' AND psm BETWEEN 450 AND 10000) OR (deal_type = 'rent' AND psm BETWEEN 3 AND 70)"""))
def rates_in_band(spark, root):
    rows = M.with_plain_rate(listing_view(spark, root))
    return rows.where(in_band(F.col("psm_usd"), F.col("deal_type"))).select("listing_id", "psm_usd")


HINT = """hint AS (
  SELECT r.*, x.rate_usd, CASE WHEN r.ref_median_psm > 0 THEN (r.ref_median_psm - x.rate_usd) / r.ref_median_psm END AS share
  FROM ref r JOIN rates x ON r.listing_id = x.listing_id)"""
HINT_COLUMNS = (
    "coalesce(NOT exclude_from_stats AND share >= 0.12, false) AS below_market, "
    f"CASE WHEN NOT exclude_from_stats THEN {rnd('share * 100', 1)} END AS discount_pct"
)


@query("below_market_hints", with_(LV, MK, COHORTS, MARKET, REF, RATES, HINT, body=f"SELECT listing_id, {HINT_COLUMNS} FROM hint"))
def below_market(spark, root):
    return M.with_market_hint(market_view(spark, root), _market(spark, root)).select("listing_id", "below_market", "discount_pct")
