"""Activity over the event log: counters, newest ids, seller stress, recent rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotlens.config import DEFAULT, MarketConfig
from lotlens.operators.changes import KEY
from lotlens.operators.relational import latest_by, lookup_join


def since(as_of: Column, hours: int = 0, days: int = 0) -> Column:
    return as_of - F.expr(f"INTERVAL {hours + 24 * days} HOURS")


def is_price_drop() -> Column:
    return (F.col("event_type") == "price_changed") & (F.col("payload.new_price") < F.col("payload.old_price"))


def attach(events: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of events to a table with unique keys; hot keys do not pile up."""
    weights = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("_weight"))
    right = table.join(weights, keys).withColumn("_found", F.lit(True))
    return lookup_join(events, right, keys, "_weight").where(F.col("_found")).drop("_found", "_weight")


def listing_events(
    events: DataFrame, listings: DataFrame, event_type: str, start: Column, deal_type: str | None = None
) -> DataFrame:
    """Events of one type in the window with their listing."""
    picked = events.where((F.col("event_type") == event_type) & (F.col("occurred_at") >= start))
    side = listings if deal_type is None else listings.where(F.col("deal_type") == deal_type)
    extra = [c for c in side.columns if c not in events.columns]
    return attach(picked, side.select(*KEY, *extra), KEY)


def property_events(
    events: DataFrame, properties: DataFrame, event_type: str, start: Column, deal_type: str | None = None
) -> DataFrame:
    """Events of one type in the window with their premises (key ``property_key``)."""
    picked = events.where(
        (F.col("event_type") == event_type) & (F.col("occurred_at") >= start) & F.col("property_key").isNotNull()
    )
    side = properties if deal_type is None else properties.where(F.col("deal_type") == deal_type)
    extra = [c for c in side.columns if c not in events.columns]
    return attach(picked, side.select("property_key", *extra), ["property_key"])


def _events_per_listing(events: DataFrame) -> DataFrame:
    """Event counts per listing: collapsed before any join."""
    return events.where(F.col("external_id").isNotNull()).groupBy(*KEY).agg(
        F.count_if(F.col("event_type") == "appeared").alias("appeared"),
        F.count_if(F.col("event_type") == "relisted").alias("relisted"),
        F.count_if(F.col("event_type") == "vanished").alias("vanished"),
        F.count_if(is_price_drop()).alias("price_drops"),
    )


def count_listing_events(events: DataFrame, listings: DataFrame, start: Column, deal_type: str | None = None) -> DataFrame:
    """Number of listing events per type in the window."""
    side = listings if deal_type is None else listings.where(F.col("deal_type") == deal_type)
    per = events.where(F.col("occurred_at") >= start).groupBy(*KEY, "event_type").agg(F.count(F.lit(1)).alias("n"))
    return per.join(side.select(*KEY), KEY, "left_semi").groupBy("event_type").agg(F.sum("n").alias("n"))


def vanished_properties(events: DataFrame, properties: DataFrame, start: Column, deal_type: str | None = None) -> DataFrame:
    """Distinct premises with a vanish event in the window (deal type of the premises)."""
    gone = events.where(
        (F.col("event_type") == "vanished") & (F.col("occurred_at") >= start) & F.col("property_key").isNotNull()
    ).select("property_key").distinct()
    if deal_type is not None:
        side = properties.where(F.col("deal_type") == deal_type).select("property_key")
        gone = gone.join(side, "property_key", "left_semi")
    return gone


def price_drop_ids(events: DataFrame, start: Column, listings: DataFrame | None = None, deal_type: str | None = None) -> DataFrame:
    """Listings with a price drop in the window and the time of the newest one."""
    drops = events.where(is_price_drop() & (F.col("occurred_at") >= start) & F.col("external_id").isNotNull())
    ids = drops.groupBy(*KEY).agg(F.max("occurred_at").alias("occurred_at"))
    if deal_type is not None:
        ids = ids.join(listings.where(F.col("deal_type") == deal_type).select(*KEY), KEY, "left_semi")
    return ids


def representative(listings: DataFrame) -> DataFrame:
    """Latest vanished listing of each premises."""
    order = [F.col(c) for c in ("vanished_at", "last_seen_at", *KEY)]
    return latest_by(listings.where(F.col("status") == "vanished"), ["property_key"], order)


def vanished_listing_ids(
    events: DataFrame, listings: DataFrame, properties: DataFrame, start: Column, deal_type: str | None = None
) -> DataFrame:
    """One listing per premises vanished in the window: of the newest event, else the representative."""
    picked = events.where(
        (F.col("event_type") == "vanished") & (F.col("occurred_at") >= start) & F.col("property_key").isNotNull()
    ).select("property_key", "occurred_at", *KEY)
    newest = latest_by(picked, ["property_key"], [F.col("occurred_at"), F.coalesce("source", F.lit("")), F.coalesce("external_id", F.lit(""))])
    if deal_type is not None:
        side = properties.where(F.col("deal_type") == deal_type).select("property_key")
        newest = newest.join(side, "property_key", "left_semi")
    reps = representative(listings).select(
        "property_key", F.col("source").alias("_s"), F.col("external_id").alias("_e"))
    return newest.join(reps, "property_key", "left").select(
        "property_key", F.coalesce("source", "_s").alias("source"),
        F.coalesce("external_id", "_e").alias("external_id"), "occurred_at",
    ).where(F.col("external_id").isNotNull())


def by_activity_rank(listings: DataFrame, ids: DataFrame) -> DataFrame:
    """Listings of an id list, newest activity first."""
    hits = listings.join(ids.select(*KEY, "occurred_at"), KEY)
    return hits.orderBy(F.col("occurred_at").desc(), *KEY)


def activity_summary(
    events: DataFrame, listings: DataFrame, properties: DataFrame, hypotheses: DataFrame, as_of: Column,
    hours: int = 24, deal_type: str | None = None,
) -> DataFrame:
    """One row of counters over the window: each part counts on its own, then they meet as rows."""
    start = since(as_of, hours)
    side = listings if deal_type is None else listings.where(F.col("deal_type") == deal_type)
    per = _events_per_listing(events.where(F.col("occurred_at") >= start)).join(side.select(*KEY), KEY, "left_semi")
    marks = {"sale": ["sold_marked"], "rent": ["rented_marked"]}.get(deal_type, ["sold_marked", "rented_marked"])
    marked = side.where(F.col("status").isin(*marks) & (F.col("updated_at") >= start))
    likely = hypotheses.where((F.col("bucket") == "likely_deal") & (F.col("created_at") >= start)).join(
        side.select(*KEY), KEY, "left_semi")
    parts = [
        per.agg(
            F.coalesce(F.sum("appeared"), F.lit(0)).alias("new_listings"),
            F.coalesce(F.sum("relisted"), F.lit(0)).alias("relisted"),
            F.count_if(F.col("price_drops") > 0).alias("price_drops"),
        ).select(F.explode(F.create_map(*[
            x for c in ("new_listings", "relisted", "price_drops") for x in (F.lit(c), F.col(c))
        ])).alias("k", "n")),
        vanished_properties(events, properties, start, deal_type).agg(F.lit("vanished").alias("k"), F.count(F.lit(1)).alias("n")),
        marked.agg(F.lit("sold_or_rented").alias("k"), F.count(F.lit(1)).alias("n")),
        likely.agg(F.lit("likely_deals").alias("k"), F.count(F.lit(1)).alias("n")),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    names = ["new_listings", "vanished", "relisted", "price_drops", "sold_or_rented", "likely_deals"]
    return rows.agg(F.lit(hours).alias("hours"), *[F.max(F.when(F.col("k") == n, F.col("n"))).alias(n) for n in names])


def seller_stress(
    events: DataFrame, listings: DataFrame, inventory: DataFrame, as_of: Column, days: int = 7,
    deal_type: str | None = None, cfg: MarketConfig = DEFAULT,
) -> DataFrame:
    """Seller pressure 0-100 per district from vanished, relisted and reduced listings.

    ``listings`` carries ``district_norm``; events collapse to one row per listing first.
    """
    side = listings if deal_type is None else listings.where(F.col("deal_type") == deal_type)
    per = _events_per_listing(events.where(F.col("occurred_at") >= since(as_of, days=days)))
    signals = per.join(side.select(*KEY, "district_norm"), KEY).where(F.col("district_norm").isNotNull()).groupBy(
        F.col("district_norm").alias("district")
    ).agg(*[F.sum(c).alias(c) for c in ("vanished", "relisted", "price_drops")])
    amount = {"sale": F.col("sale"), "rent": F.col("rent")}.get(deal_type, F.col("sale") + F.col("rent"))
    stock = inventory.where(F.col("scope") == "district").select("district", amount.alias("active"))
    n = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    gone, back, cut = cfg.stress_weights
    pressure = (n("vanished") * gone + n("relisted") * back + n("price_drops") * cut) / F.greatest(n("active"), F.lit(1))
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.rint(pressure * cfg.stress_scale))).cast("int")
    return (
        signals.join(stock, "district", "full")
        .select("district", score.alias("score"), *[n(c).alias(c) for c in ("vanished", "relisted", "price_drops", "active")])
        .where((F.col("active") > 0) | (F.col("vanished") + F.col("relisted") + F.col("price_drops") > 0))
        .orderBy(F.col("score").desc(), "district")
    )


def relisted_properties(events: DataFrame, as_of: Column, days: int = DEFAULT.relisted_soon_days) -> DataFrame:
    """Premises with a relist event in the last days."""
    recent_ = (F.col("event_type") == "relisted") & (F.col("occurred_at") >= since(as_of, days=days))
    return events.where(recent_ & F.col("property_key").isNotNull()).select("property_key").distinct()


def last_reactivation(events: DataFrame) -> DataFrame:
    """Last appeared or relisted time per premises."""
    return (
        events.where(F.col("event_type").isin("appeared", "relisted") & F.col("property_key").isNotNull())
        .groupBy("property_key").agg(F.max("occurred_at").alias("reactivated_at"))
    )


def previous_price(events: DataFrame) -> DataFrame:
    """Old price of the latest price change per listing."""
    changed = events.where(F.col("event_type") == "price_changed")
    return changed.groupBy(*KEY).agg(F.max_by("payload.old_price", "occurred_at").alias("previous_price"))


def recent(df: DataFrame, time: str, as_of: Column, hours: int, n: int, tie: list[str]) -> DataFrame:
    """Newest rows of a log within the last hours."""
    rows = df.where(F.col(time) >= since(as_of, hours)) if hours > 0 else df
    return rows.orderBy(F.col(time).desc(), *tie).limit(n)


def list_events(events: DataFrame, event_type: str | None = None, limit: int = 100) -> DataFrame:
    rows = events if event_type is None else events.where(F.col("event_type") == event_type)
    return rows.orderBy(F.col("occurred_at").desc(), "event_id").limit(max(1, limit))
