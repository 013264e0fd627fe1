"""Common table expressions of the SQL checks: the same views, spelled in SQL."""

from __future__ import annotations

LISTINGS_AS_OF = "TIMESTAMP '2001-08-01 00:00:00'"
LOG_AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"


def rnd(x: str, digits: int) -> str:
    """Half-up rounding of the printed decimal value."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 20)), {digits}) AS DOUBLE)"


LV = f"""lv AS (
  SELECT o_orderkey AS listing_id, o_custkey AS property_id, CAST(o_custkey AS VARCHAR) AS property_key,
    o_orderpriority AS source, CAST(o_orderkey AS VARCHAR) AS external_id,
    'https://site.example/item/' || o_orderkey AS url,
    CASE WHEN o_orderkey % 2 = 0 THEN 'sale' ELSE 'rent' END AS deal_type,
    'Lot ' || c_name AS title,
    CASE WHEN o_orderkey % 9 = 0 THEN 'NOI ' || (1000 + o_orderkey % 500) || ', cap rate ' || (o_orderkey % 12 + 1) || '%' END AS description,
    CASE o_orderkey % 6 WHEN 0 THEN 'office' WHEN 1 THEN 'retail' WHEN 2 THEN 'showroom'
      WHEN 3 THEN 'business_center' WHEN 4 THEN 'warehouse' ELSE 'free_purpose' END AS property_type,
    CASE WHEN o_orderkey % 31 <> 0 THEN o_totalprice END AS price,
    CASE o_orderkey % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'UAH' ELSE 'EUR' END AS currency,
    CASE o_orderkey % 4 WHEN 1 THEN CASE WHEN o_orderkey % 31 <> 0 THEN o_totalprice END
      WHEN 2 THEN {rnd('CASE WHEN o_orderkey % 31 <> 0 THEN o_totalprice END / CASE WHEN o_orderkey % 17 <> 0 THEN 20 + o_orderkey % 280 END', 4)}
      WHEN 3 THEN {rnd('CASE WHEN o_orderkey % 31 <> 0 THEN o_totalprice END / 100', 2)} END AS price_per_sqm,
    CASE WHEN o_orderkey % 17 <> 0 THEN CAST(20 + o_orderkey % 280 AS DOUBLE) END AS area_sqm,
    CAST(o_orderkey % 9 AS INTEGER) AS floor,
    n_name || ' street ' || (o_orderkey % 100) AS address_raw,
    CASE WHEN o_orderkey % 19 <> 0 THEN n_name END AS district,
    CASE WHEN o_orderkey % 7 <> 0 THEN 'Kyiv' ELSE 'Elsewhere' END AS city,
    CASE WHEN o_orderkey % 5 <> 0 THEN '+38050' || lpad(CAST(o_custkey % 10000000 AS VARCHAR), 7, '0') END AS phone,
    CASE WHEN o_orderkey % 3 <> 1 THEN c_mktsegment END AS agency,
    CASE WHEN o_orderkey % 11 = 0 THEN 'sold' WHEN o_orderkey % 13 = 0 THEN 'rented' WHEN o_orderkey % 37 = 0 THEN 'inactive_404' END AS source_status_raw,
    CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'P' THEN 'relisted' ELSE 'vanished' END AS status,
    o_orderdate AS first_seen_at,
    o_orderdate + to_days(CAST(o_orderkey % 120 AS INTEGER)) AS last_seen_at,
    CASE WHEN o_orderstatus NOT IN ('O', 'P') THEN o_orderdate + to_days(CAST(o_orderkey % 120 AS INTEGER)) END AS vanished_at,
    CASE WHEN o_orderkey % 23 = 0 THEN 2 ELSE 0 END AS price_drop_count,
    o_orderkey % 29 = 0 AS exclude_from_stats,
    CASE WHEN o_orderkey % 2 = 1 THEN CASE o_orderkey % 8 WHEN 1 THEN 'with' WHEN 3 THEN 'without' ELSE 'unknown' END END AS opex
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def usd(price: str, currency: str) -> str:
    return f"(CASE {currency} WHEN 'USD' THEN {price} WHEN 'UAH' THEN {price} / 44.61 WHEN 'EUR' THEN {price} * 1.169 END)"


ACTIVE = "status IN ('active', 'relisted')"

MK = f"""mk AS (
  SELECT *, psm AS psm_usd FROM (
    SELECT *, {usd('price', 'currency')} / area_sqm AS psm, (city = 'Kyiv' OR district IS NOT NULL) AS in_city FROM lv
    WHERE {ACTIVE} AND NOT exclude_from_stats)
  WHERE (deal_type = 'sale' AND psm BETWEEN 450 AND 10000) OR (deal_type = 'rent' AND psm BETWEEN 3 AND 70))"""

# cohort membership of market rows, then statistics for (cohort, district) and (cohort, city)
COHORTS = """coh AS (
  SELECT 'sale' AS cohort, district, in_city, psm FROM mk WHERE deal_type = 'sale'
  UNION ALL SELECT 'rent', district, in_city, psm FROM mk WHERE deal_type = 'rent'
  UNION ALL SELECT CASE opex WHEN 'with' THEN 'rent_with_opex' WHEN 'without' THEN 'rent_without_opex' ELSE 'rent_opex_unknown' END,
    district, in_city, psm FROM mk WHERE deal_type = 'rent')"""
MARKET = """market AS (
  SELECT cohort, district, round(avg(psm), 1) AS avg_psm, round(median(psm), 1) AS median_psm, count(*) AS n
  FROM coh WHERE district IS NOT NULL GROUP BY cohort, district
  UNION ALL
  SELECT cohort, NULL, round(avg(psm), 1), round(median(psm), 1), count(*) FROM coh WHERE in_city GROUP BY cohort)"""
RENT_PICK = """pick AS (
  SELECT m.* FROM market m WHERE m.cohort = CASE WHEN (SELECT coalesce(max(n), 0) FROM market WHERE cohort = 'rent_without_opex' AND district IS NULL) >= 15
    THEN 'rent_without_opex' ELSE 'rent' END)"""
INVENTORY = f"""inv AS (
  SELECT CASE WHEN district IS NULL THEN 'no_district' ELSE 'district' END AS scope, district,
    count(*) FILTER (deal_type = 'sale') AS sale, count(*) FILTER (deal_type = 'rent') AS rent
  FROM lv WHERE {ACTIVE} GROUP BY district
  UNION ALL SELECT 'total', NULL, count(*) FILTER (deal_type = 'sale'), count(*) FILTER (deal_type = 'rent') FROM lv WHERE {ACTIVE})"""

OBS = """obs AS (
  SELECT event_type AS source, CAST(user_id AS VARCHAR) AS external_id, ts AS seen_at, event_id AS seq,
    CAST(user_id AS VARCHAR) AS property_key, CASE WHEN user_id % 2 = 0 THEN 'sale' ELSE 'rent' END AS deal_type,
    CASE WHEN event_id % 13 <> 0 THEN value END AS price, 'USD' AS currency,
    CASE WHEN k % 6 <> 0 THEN 'T' || (k % 4) END AS title, CAST(20 + user_id % 280 AS DOUBLE) AS area_sqm,
    CASE WHEN k % 7 = 0 THEN 'D' || (k % 3) END AS description,
    CASE WHEN k % 5 = 0 THEN '050' || lpad(CAST(user_id AS VARCHAR), 7, '0') END AS phone,
    CASE WHEN k % 20 = 0 THEN 'sold' WHEN k % 20 = 1 THEN 'inactive' WHEN k % 20 < 5 THEN 'active' END AS source_status_raw,
    n_name AS district
  FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events) e JOIN nation ON n_nationkey = user_id % 25)"""


def mapped(x: str) -> str:
    return f"(CASE WHEN {x} LIKE '%sold%' THEN 'sold_marked' WHEN {x} LIKE '%inactive%' THEN 'vanished' ELSE 'active' END)"


def _sticky(cols) -> str:
    return ", ".join(f"last_value({c} IGNORE NULLS) OVER wp AS prev_{c}" for c in cols)


RUNS = """runs AS (
  SELECT source, date_trunc('day', seen_at) AS started_at, date_trunc('day', seen_at) + INTERVAL 1 DAY AS run_at,
    count(DISTINCT external_id) AS seen FROM obs GROUP BY 1, 2, 3 HAVING count(DISTINCT external_id) >= 5)"""
MISSED_BY_RUN = ("(SELECT min(r.run_at) FROM runs r WHERE r.source = p.source AND r.started_at > p.prev_seen_at "
                 "AND r.run_at > p.prev_seen_at + INTERVAL 6 HOUR)")
MISSED_BY_IDLE = "(p.prev_seen_at + INTERVAL 72 HOUR)"


def tracked(missed: str) -> str:
    """Observations with previous values; ``trk`` also holds the stored status before each."""
    return f"""prv AS (
  SELECT *, lag(seen_at) OVER w AS prev_seen_at, {_sticky(['price', 'currency', 'title', 'area_sqm', 'description', 'phone', 'source_status_raw'])}
  FROM obs WINDOW w AS (PARTITION BY source, external_id ORDER BY seen_at, seq),
    wp AS (PARTITION BY source, external_id ORDER BY seen_at, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ms AS (SELECT p.*, {missed} AS missed FROM prv p),
trk AS (
  SELECT *, CASE WHEN prev_mapped = 'active' AND missed < seen_at THEN 'vanished' ELSE prev_mapped END AS stored_status,
    CASE WHEN prev_mapped = 'active' AND missed < seen_at THEN missed WHEN prev_mapped = 'vanished' THEN prev_seen_at END AS stored_vanished_at,
    coalesce(price < prev_price, false) AS price_dropped
  FROM (SELECT *, {mapped('coalesce(source_status_raw, prev_source_status_raw)')} AS mapped_status,
    CASE WHEN prev_seen_at IS NOT NULL THEN {mapped('prev_source_status_raw')} END AS prev_mapped FROM ms)),
chg AS (
  SELECT source, external_id, property_key, deal_type, district, 'appeared' AS event_type, seen_at AS occurred_at,
    NULL::DOUBLE AS old_price, NULL::DOUBLE AS new_price, NULL::VARCHAR AS old_status, NULL::VARCHAR AS new_status, NULL::TIMESTAMP AS previous_vanished_at
  FROM trk WHERE prev_seen_at IS NULL
  UNION ALL SELECT source, external_id, property_key, deal_type, district, 'relisted', seen_at, NULL, NULL, NULL, NULL, stored_vanished_at
  FROM trk WHERE stored_status = 'vanished'
  UNION ALL SELECT source, external_id, property_key, deal_type, district, 'price_changed', seen_at, prev_price, price, NULL, NULL, NULL
  FROM trk WHERE prev_seen_at IS NOT NULL AND price <> prev_price
  UNION ALL SELECT source, external_id, property_key, deal_type, district, 'status_changed', seen_at, NULL, NULL,
    CASE WHEN stored_status = 'vanished' THEN 'relisted' ELSE stored_status END, mapped_status, NULL
  FROM trk WHERE prev_seen_at IS NOT NULL AND mapped_status <> 'active'
    AND mapped_status <> CASE WHEN stored_status = 'vanished' THEN 'relisted' ELSE stored_status END)"""


FOLD = f"""fold0 AS (
  SELECT source, external_id, max(property_key) AS property_key, max(deal_type) AS deal_type, max(district) AS district,
    arg_max(price, (seen_at, seq)) FILTER (price IS NOT NULL) AS price,
    arg_max(title, (seen_at, seq)) FILTER (title IS NOT NULL) AS title, max(area_sqm) AS area_sqm,
    arg_max(description, (seen_at, seq)) FILTER (description IS NOT NULL) AS description, max(phone) AS phone,
    arg_max(source_status_raw, (seen_at, seq)) FILTER (source_status_raw IS NOT NULL) AS source_status_raw,
    min(seen_at) AS first_seen_at, max(seen_at) AS last_seen_at, CAST(sum(CASE WHEN price_dropped THEN 1 ELSE 0 END) AS INTEGER) AS price_drop_count
  FROM trk GROUP BY source, external_id),
ls AS (
  SELECT *, 'USD' AS currency, last_seen_at AS updated_at,
    CASE WHEN m = 'active' AND last_seen_at + INTERVAL 72 HOUR <= {LOG_AS_OF} THEN 'vanished' ELSE m END AS status,
    CASE WHEN m = 'active' AND last_seen_at + INTERVAL 72 HOUR <= {LOG_AS_OF} THEN last_seen_at + INTERVAL 72 HOUR
      WHEN m = 'vanished' THEN last_seen_at END AS vanished_at
  FROM (SELECT *, {mapped('source_status_raw')} AS m FROM fold0))"""

EVENTS = """ev AS (
  SELECT * FROM chg
  UNION ALL SELECT source, external_id, property_key, deal_type, district, 'vanished', stored_vanished_at, NULL, NULL, NULL, NULL, NULL
  FROM trk WHERE prev_mapped = 'active' AND stored_status = 'vanished'
  UNION ALL SELECT source, external_id, property_key, deal_type, district, 'vanished', vanished_at, NULL, NULL, NULL, NULL, NULL
  FROM ls WHERE m = 'active' AND status = 'vanished')"""

PROPS = f"""pr AS (
  SELECT property_key, min(deal_type) AS deal_type, min(district) AS district, min(first_seen_at) AS first_seen_at, max(last_seen_at) AS last_seen_at,
    bool_or({ACTIVE}) AS is_active FROM ls GROUP BY property_key)"""

MART = ",\n".join([OBS, tracked(MISSED_BY_IDLE), FOLD, EVENTS, PROPS])


def with_(*parts: str, body: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + body


def ts(col: str) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S') AS {col.split('.')[-1]}"
