"""Market statistics: medians by district and cohort, inventory, yield, daily series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotlens.config import ACTIVE_STATUSES, DEFAULT, MarketConfig
from lotlens.functions import rules
from lotlens.functions.money import in_band, to_usd, with_effective_rate
from lotlens.functions.text import any_contains, blank_safe, listing_district, resolve_opex
from lotlens.operators.relational import checked_broadcast, exact_median
from lotlens.session import stored

CITY = "*"
OPEX_COHORT = {"with": "rent_with_opex", "without": "rent_without_opex", "unknown": "rent_opex_unknown"}


def is_active(status: str = "status") -> Column:
    return F.col(status).isin(*ACTIVE_STATUSES)


def active(df: DataFrame) -> DataFrame:
    return df.where(is_active())


def for_stats(df: DataFrame) -> DataFrame:
    return df.where(~F.coalesce("exclude_from_stats", F.lit(False)))


def excluded_only(df: DataFrame) -> DataFrame:
    return df.where(F.coalesce("exclude_from_stats", F.lit(False)))


def prepare_market(listings: DataFrame) -> DataFrame:
    """Adds the district, city membership and OPEX class that market reports group by."""
    district = listing_district()
    city = F.lower(blank_safe(F.col("city")))
    return listings.withColumn("district_norm", district).withColumns({
        "in_city": any_contains(city, rules.CITY_NAMES) | F.col("district_norm").isNotNull(),
        "opex": F.when(F.col("deal_type") == "rent",
                       resolve_opex(F.col("raw_extra.opex"), F.col("title"), F.col("description"))),
    })


def with_plain_rate(df: DataFrame, name: str = "psm_usd", cfg: MarketConfig = DEFAULT) -> DataFrame:
    """USD per square metre of the stored price and area (no repair)."""
    return df.withColumn(
        name, F.when(F.col("area_sqm") > 0, to_usd(F.col("price"), F.col("currency"), cfg) / F.col("area_sqm"))
    )


def market_rows(prepared: DataFrame, active_only: bool = True, cfg: MarketConfig = DEFAULT) -> DataFrame:
    """Listings that enter market statistics, with their rate ``psm_usd``."""
    rows = for_stats(prepared.where(F.col("deal_type").isin("sale", "rent")))
    if active_only:
        rows = active(rows)
    return with_plain_rate(rows, cfg=cfg).where(in_band(F.col("psm_usd"), F.col("deal_type"), cfg))


def _slices(rows: DataFrame, cohorts: Column, by: Sequence[str] = ()) -> DataFrame:
    """Statistics per (by, cohort, scope); a row enters its city and its district."""
    scopes = F.filter(
        F.array(F.when(F.col("in_city"), F.lit(CITY)), F.col("district_norm")), lambda s: s.isNotNull()
    )
    members = (
        rows.select(*by, "psm_usd", cohorts.alias("_cohorts"), scopes.alias("_scopes"))
        .select(*by, "psm_usd", "_scopes", F.explode("_cohorts").alias("cohort"))
        .select(*by, "psm_usd", "cohort", F.explode("_scopes").alias("_scope"))
    )
    stats = exact_median(members, [*by, "cohort", "_scope"], "psm_usd")
    return stats.select(
        *by, "cohort", F.when(F.col("_scope") != CITY, F.col("_scope")).alias("district"),
        F.round("mean", 1).alias("avg_psm"), F.round("median", 1).alias("median_psm"), "n",
    )


def all_market_stats(
    prepared: DataFrame, by: Sequence[str] = (), active_only: bool = True, cfg: MarketConfig = DEFAULT
) -> DataFrame:
    """All cohorts in one pass: (cohort, district, avg_psm, median_psm, n); city = null district."""
    opex = F.col("opex")
    rent_part = (
        F.when(opex == "with", OPEX_COHORT["with"]).when(opex == "without", OPEX_COHORT["without"])
        .otherwise(OPEX_COHORT["unknown"])
    )
    cohorts = F.when(F.col("deal_type") == "sale", F.array(F.lit("sale"))).otherwise(
        F.array(F.lit("rent"), rent_part)
    )
    return _slices(market_rows(prepared, active_only, cfg), cohorts, by)


def market_stats(
    prepared: DataFrame, deal_type: str, opex: str | None = None, active_only: bool = True,
    cfg: MarketConfig = DEFAULT,
) -> DataFrame:
    """One deal type: city row (null district) and district rows."""
    rows = market_rows(prepared.where(F.col("deal_type") == deal_type), active_only, cfg)
    if deal_type == "rent" and opex:
        rows = rows.where(F.col("opex") == opex)
    return _slices(rows, F.array(F.lit(deal_type)))


def active_inventory(prepared: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Active listings for sale and rent: a total row, a no-district row, one row per district."""
    place = F.when(F.col("district_norm").isNull(), "no_district").otherwise("district")
    counted = active(prepared).groupBy(*by, "district_norm").agg(
        F.count_if(F.col("deal_type") == "sale").alias("sale"),
        F.count_if(F.col("deal_type") == "rent").alias("rent"),
    )
    scoped = counted.select(
        *by, F.explode(F.array(F.lit("total"), place)).alias("scope"), "district_norm", "sale", "rent"
    )
    return (
        scoped.groupBy(*by, "scope", F.when(F.col("scope") == "district", F.col("district_norm")).alias("district"))
        .agg(F.sum("sale").alias("sale"), F.sum("rent").alias("rent"))
        .where((F.col("sale") > 0) | (F.col("rent") > 0) | (F.col("scope") != "district"))
    )


def pick_rent_slice(market: DataFrame, opex: str | None = None, by: Sequence[str] = (), cfg: MarketConfig = DEFAULT) -> DataFrame:
    """Rent slice of the asked OPEX class, else net rent when its city sample is large enough.

    The choice rides on a window over the market table (one row per cohort and district).
    """
    if opex in OPEX_COHORT:
        return market.where(F.col("cohort") == OPEX_COHORT[opex])
    net = F.max(F.when((F.col("cohort") == "rent_without_opex") & F.col("district").isNull(), F.col("n")))
    rent = market.where(F.col("cohort").isin("rent", "rent_without_opex"))
    one = list(by) or [F.lit(1)]
    sized = rent.withColumn("_net", net.over(Window.partitionBy(*one)))
    wanted = F.when(F.coalesce("_net", F.lit(0)) >= cfg.net_rent_min_sample, "rent_without_opex").otherwise("rent")
    return sized.where(F.col("cohort") == wanted).drop("_net")


def _side(slice_: DataFrame, prefix: str, by: Sequence[str] = ()) -> DataFrame:
    return slice_.select(
        *by, F.coalesce("district", F.lit(CITY)).alias("_scope"),
        F.col("avg_psm").alias(f"{prefix}_avg"), F.col("median_psm").alias(f"{prefix}_median"),
        F.col("n").alias(f"{prefix}_n"),
    )


def _district() -> Column:
    return F.when(F.col("_scope") != CITY, F.col("_scope")).alias("district")


def rough_yield(market: DataFrame, cfg: MarketConfig = DEFAULT) -> DataFrame:
    """Gross yield and payback per district and city (null district), best yield first."""
    sale = _side(market.where(F.col("cohort") == "sale"), "sale")
    rent = _side(pick_rent_slice(market, cfg=cfg), "rent")
    pct = F.round(F.col("rent_median") * 12 / F.col("sale_median") * 100, 1)
    both = sale.join(rent, "_scope").where((F.col("sale_median") > 0) & (F.col("rent_median") > 0))
    return both.withColumn("yield_pct", pct).select(
        _district(), F.col("sale_median").alias("sale_median_psm"), F.col("rent_median").alias("rent_median_psm"),
        "sale_n", "rent_n", "yield_pct",
        F.when(F.col("yield_pct") > 0, F.round(100 / F.col("yield_pct"), 1)).alias("payback_years"),
    ).orderBy(F.col("yield_pct").desc(), "district")


def compare_districts(market: DataFrame, cfg: MarketConfig = DEFAULT) -> DataFrame:
    """Sale against rent per district."""
    sale = _side(market.where((F.col("cohort") == "sale") & F.col("district").isNotNull()), "sale")
    rent = _side(pick_rent_slice(market, cfg=cfg).where(F.col("district").isNotNull()), "rent")
    return sale.join(rent, "_scope", "full").select(
        F.col("_scope").alias("district"), "sale_avg", F.coalesce("sale_n", F.lit(0)).alias("sale_n"),
        "rent_avg", F.coalesce("rent_n", F.lit(0)).alias("rent_n"), "sale_median", "rent_median",
    ).orderBy(F.col("sale_avg").desc_nulls_last(), F.col("rent_avg").desc_nulls_last(), "district")


def district_report(
    market: DataFrame, inventory: DataFrame, stress: DataFrame, mode: str, opex: str | None = None,
    cfg: MarketConfig = DEFAULT,
) -> DataFrame:
    """Inventory, price sample and seller stress of one deal mode per district."""
    slice_ = market.where(F.col("cohort") == "sale") if mode == "sale" else pick_rent_slice(market, opex, cfg=cfg)
    price = slice_.where(F.col("district").isNotNull()).select(
        "district", "avg_psm", "median_psm", F.col("n").alias("sample_n"))
    stock = inventory.where(F.col("scope") == "district").select("district", F.col(mode).alias("active"))
    pressure = stress.select("district", F.col("score").alias("stress"))
    return (
        price.join(stock, "district", "full").join(pressure, "district", "full")
        .select(
            "district", F.coalesce("active", F.lit(0)).alias("active"), "avg_psm", "median_psm",
            F.coalesce("sample_n", F.lit(0)).alias("sample_n"), "stress",
        )
        .orderBy(F.col("active").desc(), F.col("median_psm").desc_nulls_last(), "district")
    )


def market_snapshot(prepared: DataFrame, by: Sequence[str] = ("day",), captured_at: Column | None = None, cfg: MarketConfig = DEFAULT) -> DataFrame:
    """One row per day: city figures and an array of district figures.

    ``prepared`` carries the day each listing counts for, so that one pass makes a series.
    """
    by = list(by)
    market = stored(all_market_stats(prepared, by, cfg=cfg), "market")
    stock = active_inventory(prepared, by).select(
        *by, F.when(F.col("scope") == "total", CITY).otherwise(F.col("district")).alias("_scope"),
        F.col("sale").alias("sale_active"), F.col("rent").alias("rent_active"),
    ).where(F.col("_scope").isNotNull())
    sale = _side(market.where(F.col("cohort") == "sale"), "sale", by)
    rent = _side(pick_rent_slice(market, by=by, cfg=cfg), "rent", by)
    wide = stock.join(sale, [*by, "_scope"], "full").join(rent, [*by, "_scope"], "full")
    n0 = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    point = F.struct(
        F.col("_scope").alias("district"), "sale_median", "sale_avg", n0("sale_n"),
        "rent_median", "rent_avg", n0("rent_n"), n0("sale_active"), n0("rent_active"),
    )
    in_city = F.col("_scope") == CITY
    pick = lambda c: F.max(F.when(in_city, F.col(c)))
    rows = wide.groupBy(*by).agg(
        pick("sale_median").alias("sale_median_psm"), pick("sale_avg").alias("sale_avg_psm"),
        F.coalesce(pick("sale_n"), F.lit(0)).alias("sale_sample_n"),
        F.coalesce(pick("sale_active"), F.lit(0)).alias("sale_active_n"),
        pick("rent_median").alias("rent_median_psm"), pick("rent_avg").alias("rent_avg_psm"),
        F.coalesce(pick("rent_n"), F.lit(0)).alias("rent_sample_n"),
        F.coalesce(pick("rent_active"), F.lit(0)).alias("rent_active_n"),
        F.array_sort(F.collect_list(F.when(~in_city, point))).alias("districts"),
    )
    at = captured_at if captured_at is not None else F.col(by[0]).cast("timestamp")
    return rows.withColumn("captured_at", at)


def series(daily: DataFrame, limit: int = 90) -> DataFrame:
    """The last days of the daily series, oldest first."""
    return daily.orderBy(F.col("day").desc()).limit(max(1, limit)).orderBy("day")


def with_market_reference(listings: DataFrame, market: DataFrame) -> DataFrame:
    """Reference median of a listing: its cohort's district, else the cohort's city.

    The cohort follows the deal type and, for rent, the OPEX class when that class has any
    sample. ``market`` is a stored table with one row per cohort and district; it is broadcast while it is counted to be small.
    """
    market = checked_broadcast(market)
    city = market.where(F.col("district").isNull()).select(
        F.col("cohort").alias("_c"), F.col("median_psm").alias("_city"), F.col("n").alias("_city_n"))
    places = market.where(F.col("district").isNotNull()).select(
        F.col("cohort").alias("_pc"), F.col("district").alias("_pd"), F.col("median_psm").alias("_place"))
    asked = (
        F.when(F.col("deal_type") == "sale", "sale")
        .when(F.col("opex") == "without", OPEX_COHORT["without"])
        .when(F.col("opex") == "with", OPEX_COHORT["with"]).otherwise("rent")
    )
    known = market.where(F.col("district").isNull() & (F.col("n") > 0)).select(F.col("cohort").alias("_asked"), F.lit(True).alias("_has"))
    chosen = F.when(F.col("_has") | (F.col("_asked") == "sale"), F.col("_asked")).otherwise("rent")
    return (
        listings.withColumn("_asked", asked).join(known, "_asked", "left")
        .withColumn("cohort", chosen)
        .join(city, F.col("cohort") == F.col("_c"), "left")
        .join(places, (F.col("cohort") == F.col("_pc")) & (F.col("district_norm") == F.col("_pd")), "left")
        .select(*listings.columns, "cohort", F.coalesce("_place", "_city").alias("ref_median_psm"))
    )


def with_market_hint(listings: DataFrame, market: DataFrame, cfg: MarketConfig = DEFAULT) -> DataFrame:
    """Discount of the repaired rate against the reference median; 12 % or more is a hint."""
    referred = with_effective_rate(with_market_reference(listings, market), "_rate", cfg)
    ref = F.col("ref_median_psm")
    referred = referred.withColumn("_share", F.when(ref > 0, (ref - F.col("_rate")) / ref))
    counted = ~F.coalesce("exclude_from_stats", F.lit(False))
    return referred.withColumns({
        "below_market": F.coalesce(counted & (F.col("_share") >= cfg.below_market_threshold), F.lit(False)),
        "discount_pct": F.when(counted, F.round(F.col("_share") * 100, 1)),
    }).drop("_rate", "_share")
