"""Table schemas of the mart."""

from __future__ import annotations

EXTRA = (
    "STRUCT<cap_rate_pct DOUBLE, noi DOUBLE, opex STRING, price_was_psm BOOLEAN, "
    "price_norm STRING, price_suspicious BOOLEAN, stats_review_ok BOOLEAN, "
    "stats_exclude_manual BOOLEAN, stats_auto_excluded BOOLEAN, skip_detail BOOLEAN, "
    "zone STRING, from_json_ld BOOLEAN, detail BOOLEAN, phones ARRAY<STRING>, "
    "status STRING, list_only BOOLEAN, snippet STRING, olx_status STRING, seller STRING>"
)

CARD = (
    "source STRING, external_id STRING, url STRING, deal_type STRING, title STRING, "
    "description STRING, property_type STRING, price DOUBLE, currency STRING, "
    "price_per_sqm DOUBLE, area_sqm DOUBLE, floor INT, rooms INT, address_raw STRING, "
    "district STRING, city STRING, lat DOUBLE, lon DOUBLE, phone STRING, agency STRING, "
    "source_status_raw STRING"
)

PAYLOAD = (
    "STRUCT<source STRING, external_id STRING, url STRING, previous_vanished_at TIMESTAMP, "
    "old_price DOUBLE, new_price DOUBLE, currency STRING, old_status STRING, "
    "new_status STRING, source_status_raw STRING, sources_vanished ARRAY<STRING>, "
    "trigger_source STRING, trigger_external_id STRING, level STRING>"
)

FEATURES = "ARRAY<STRUCT<code: STRING, points: INT, detail: STRING>>"

DISTRICT_POINTS = (
    "ARRAY<STRUCT<district: STRING, sale_median: DOUBLE, sale_avg: DOUBLE, sale_n: BIGINT, "
    "rent_median: DOUBLE, rent_avg: DOUBLE, rent_n: BIGINT, sale_active: BIGINT, rent_active: BIGINT>>"
)

TABLES = {
    "observations": f"{CARD}, published_at TIMESTAMP, extra {EXTRA}, seen_at TIMESTAMP, seq BIGINT",
    "listings": (
        f"{CARD}, raw_extra {EXTRA}, property_key STRING, status STRING, first_seen_at TIMESTAMP, "
        "last_seen_at TIMESTAMP, vanished_at TIMESTAMP, price_drop_count INT, "
        "exclude_from_stats BOOLEAN, created_at TIMESTAMP, updated_at TIMESTAMP"
    ),
    "properties": (
        "fingerprint STRING, title STRING, address_norm STRING, district STRING, city STRING, "
        "region STRING, property_type STRING, deal_type STRING, area_sqm DOUBLE, floor INT, "
        "lat DOUBLE, lon DOUBLE, first_seen_at TIMESTAMP, last_seen_at TIMESTAMP, "
        "is_active BOOLEAN, created_at TIMESTAMP, updated_at TIMESTAMP"
    ),
    "snapshots": (
        "source STRING, external_id STRING, crawled_at TIMESTAMP, price DOUBLE, currency STRING, "
        "status STRING, title STRING, area_sqm DOUBLE, payload STRING"
    ),
    "events": (
        "event_id STRING, property_key STRING, source STRING, external_id STRING, "
        f"event_type STRING, occurred_at TIMESTAMP, payload {PAYLOAD}"
    ),
    "hypotheses": (
        "property_key STRING, source STRING, external_id STRING, score INT, bucket STRING, "
        f"features {FEATURES}, human_label STRING, created_at TIMESTAMP, updated_at TIMESTAMP"
    ),
    "crawl_runs": (
        "source STRING, started_at TIMESTAMP, finished_at TIMESTAMP, status STRING, "
        "pages_fetched INT, listings_seen BIGINT, error STRING"
    ),
    "watch_filters": (
        "name STRING, q STRING, source STRING, deal_type STRING, segment STRING, district STRING, "
        "period STRING, below_market BOOLEAN, price_min DOUBLE, price_max DOUBLE, created_at TIMESTAMP"
    ),
    "market_daily": (
        "day DATE, captured_at TIMESTAMP, sale_median_psm DOUBLE, sale_avg_psm DOUBLE, "
        "sale_sample_n BIGINT, sale_active_n BIGINT, rent_median_psm DOUBLE, rent_avg_psm DOUBLE, "
        f"rent_sample_n BIGINT, rent_active_n BIGINT, districts {DISTRICT_POINTS}"
    ),
    "pages": (
        "source STRING, deal_type STRING, zone STRING, page_no INT, kind STRING, url STRING, "
        "fetched_at TIMESTAMP, html STRING"
    ),
}
CARD_COLUMNS = [part.split()[0] for part in CARD.split(", ")]
