"""Constants of the listing market: bands, rates, thresholds, points."""

from __future__ import annotations

from dataclasses import dataclass, field

# Results depend on these numbers being exactly so.
ACTIVE_STATUSES = ("active", "relisted")
STATUSES = ("active", "vanished", "sold_marked", "rented_marked", "relisted", "unknown")
DEAL_TYPES = ("sale", "rent")
BUCKETS = ("likely_deal", "ambiguous", "likely_withdrawn")
HUMAN_LABELS = ("deal", "withdrawn", "unknown")
SORT_MODES = (
    "newest", "oldest", "price_asc", "price_desc", "area_asc",
    "area_desc", "psm_asc", "psm_desc", "dom_asc", "dom_desc",
)


@dataclass(frozen=True)
class MarketConfig:
    """Every threshold an operator reads; pass a changed copy to re-tune a run."""

    # Exchange rates and plausibility bands in USD per square metre.
    uah_per_usd: float = 44.61
    usd_per_eur: float = 1.169
    sale_psm_min: float = 450.0
    sale_psm_max: float = 10_000.0
    rent_psm_min: float = 3.0
    rent_psm_max: float = 70.0
    sale_psm_floor: float = 80.0
    max_price: float = 500_000_000.0
    max_area: float = 50_000.0
    # Crawl coverage guard and vanish rule.
    min_seen_for_vanish: int = 100
    vanish_min_active_ratio: float = 0.55
    vanish_grace_hours: int = 6
    # Deal scoring.
    deal_likely_min: int = 70
    deal_ambiguous_min: int = 40
    vanish_too_fast_days: int = 3
    bulk_delist_min: int = 8
    bulk_delist_hours: int = 24
    relisted_soon_days: int = 14
    # Market reports.
    net_rent_min_sample: int = 15
    below_market_threshold: float = 0.12
    agency_phone_min: int = 3
    stress_weights: tuple[int, int, int] = field(default=(40, 25, 20))
    stress_scale: int = 8


DEFAULT = MarketConfig()
