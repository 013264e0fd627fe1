"""Market statistics and full annotation of listings whose district, OPEX class and finance terms stand in their texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotlens.functions import rules as R
from lotlens.functions.text import cap_rate, net_operating_income
from lotlens.operators import market as M
from lotlens.operators import search as X
from lotlens.plans.check_sql import COHORTS, LISTINGS_AS_OF as SQL_AS_OF, LV, MARKET, MK, with_
from lotlens.plans.market_queries import HINT, HINT_COLUMNS, RATES, REF, STATS
from lotlens.plans.registry import big, query
from lotlens.plans.search_queries import PHONES, PORTALS, SELLER_SQL, SPREAD, _with_extra
from lotlens.plans.text_queries import OPEX_CLASS, OPEX_PHRASES
from lotlens.plans.views import LISTINGS_AS_OF, as_of, listing_view
from lotlens.session import stored

PLACE = "CASE property_id % 10 " + " ".join("WHEN {} THEN '{}'".format(i, n.replace("'", "''")) for i, (n, _) in enumerate(R.DISTRICTS)) + " END"
PHRASE = "CASE (listing_id // 2) % 8 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(OPEX_CLASS)) + " END"
# A listing in five names its district nowhere, a rent listing in five has its OPEX class stored.
LVT = LV.replace("lv AS (", "lv0 AS (", 1) + f""",
lv AS (SELECT * REPLACE (CASE WHEN listing_id % 5 <> 4 THEN {PLACE} END AS district,
    CASE WHEN deal_type = 'rent' THEN CASE WHEN listing_id % 10 = 1 THEN 'with' ELSE {PHRASE} END END AS opex) FROM lv0)"""


def _rows(spark, root):
    """Listings with the district in their field, address or title, OPEX words in the description, finance terms read from it."""
    k, place = F.col("listing_id"), (F.col("property_id") % 10 + 1).cast("int")
    local, other = (F.element_at(F.array(*[F.lit(pair[i]) for pair in R.DISTRICTS]), place) for i in (0, 1))
    phrase = F.element_at(F.array(*[F.lit(p) for p in OPEX_PHRASES]), (F.floor(k / 2) % 8 + 1).cast("int"))
    rows = listing_view(spark, root).drop("opex").withColumns({
        "district": F.when(k % 5 == 0, F.concat(local, F.lit(" район"))).when(k % 5 == 2, F.concat(F.upper(other), F.lit(" р-н"))),
        "address_raw": F.when(k % 5 == 1, F.concat(F.lit("вул. Нова 5, "), local, F.lit(" район"))).otherwise(F.col("address_raw")),
        "title": F.when(k % 5 == 3, F.concat(F.lit("Офіс, "), local, F.lit(" район, 120 м²"))).otherwise(F.col("title")),
        "description": F.concat_ws(". ", "description", F.when(F.col("deal_type") == "rent", phrase)),
    })
    return _with_extra(
        rows, cap_rate_pct=cap_rate(F.col("description")), noi=net_operating_income(F.col("description")),
        opex=F.when(k % 10 == 1, "with").when(k % 10 == 3, "unknown"), price_suspicious=F.when((F.col("deal_type") == "rent") & (k % 7 == 0), True))


def _prepared(spark, root):
    """The prepared rows, stored: their text rules run once for the statistics and the annotation."""
    return stored(M.prepare_market(_rows(spark, root)), "prepared")


@query("market_from_text", with_(LVT, MK, COHORTS, MARKET, body=f"SELECT cohort, {', '.join(STATS)} FROM market"))
def market_from_text(spark, root):
    return M.all_market_stats(_prepared(spark, root)).select("cohort", *STATS)


@query("listings_annotated_in_full", with_(LVT, MK, COHORTS, MARKET, REF, RATES, HINT, PHONES, SELLER_SQL, SPREAD, PORTALS, body=f"""SELECT h.listing_id, h.district, {HINT_COLUMNS}, h.ref_median_psm,
  sel.seller, pt.portals, pt.portal_sources, pt.portal_spread_pct, CASE WHEN h.listing_id % 9 = 0 THEN CAST(h.listing_id % 12 + 1 AS DOUBLE) END AS cap_rate_pct,
  CASE WHEN h.listing_id % 9 = 0 THEN CAST(1000 + h.listing_id % 500 AS DOUBLE) END AS noi, h.opex, h.deal_type = 'rent' AND h.listing_id % 7 = 0 AS price_suspicious,
  h.exclude_from_stats AS excluded_from_stats, greatest(0, date_diff('day', h.first_seen_at, {SQL_AS_OF})) AS dom_days
FROM hint h JOIN sel ON sel.listing_id = h.listing_id JOIN pt ON pt.listing_id = h.listing_id"""))
def annotated_in_full(spark, root):
    rows = _prepared(spark, root)
    market = stored(M.all_market_stats(rows), "market")
    return X.annotate(rows, market, as_of(LISTINGS_AS_OF)).select(
        "listing_id", F.col("district_norm").alias("district"), "below_market", "discount_pct", "ref_median_psm", "seller", *big("portals"),
        F.array_join("portal_sources", ",").alias("portal_sources"), "portal_spread_pct", "cap_rate_pct", "noi", "opex", "price_suspicious", "excluded_from_stats", *big("dom_days"))
