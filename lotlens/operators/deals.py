"""Deal hypotheses: candidates, explainable score, labels and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotlens.config import BUCKETS, DEFAULT, HUMAN_LABELS, MarketConfig
from lotlens.functions import rules
from lotlens.functions.text import any_contains, blank_safe
from lotlens.operators.activity import attach, previous_price, relisted_properties, representative, since
from lotlens.operators.changes import KEY
from lotlens.operators.relational import latest_by, lookup_join
from lotlens.operators.state import source_sets


def days_between(a: Column, b: Column) -> Column:
    return F.abs((F.unix_micros(b) - F.unix_micros(a)) / 86_400_000_000)


def bucket_of(score: Column, cfg: MarketConfig = DEFAULT) -> Column:
    return F.when(score >= cfg.deal_likely_min, BUCKETS[0]).when(score >= cfg.deal_ambiguous_min, BUCKETS[1]).otherwise(BUCKETS[2])


def score_deals(candidates: DataFrame, cfg: MarketConfig = DEFAULT) -> DataFrame:
    """Score 0-100, bucket and the features that made it."""
    c = F.col
    drops = F.coalesce("price_drop_count", F.lit(0))
    days = days_between(c("first_seen_at"), c("vanished_at"))
    gone, tracked = c("vanished_on_sources"), c("tracked_sources_n")
    everywhere = (tracked >= 2) & (gone >= tracked)
    typical = F.when(c("deal_type") == "rent", days.between(7, 90)).otherwise(days.between(14, 180))
    cheaper = F.coalesce(c("last_price") < c("previous_price"), F.lit(False))

    def feature(code: str, points, when: Column, detail: Column) -> Column:
        value = points if isinstance(points, Column) else F.lit(points)
        return F.when(when, F.struct(
            F.lit(code).alias("code"), value.cast("int").alias("points"), detail.cast("string").alias("detail")))

    # Feature codes and points.
    features = F.filter(F.array(
        feature("explicit_status", 25, c("explicit_sold_or_rented"), F.lit("marked")),
        feature("vanished_all_sources", 45, everywhere, gone),
        feature("vanished_multi_source", 25, ~everywhere & (gone >= 2), gone),
        feature("vanished_single_source", 10, ~everywhere & (gone < 2), gone),
        feature("price_drop", F.least(F.lit(15), 10 + 5 * F.greatest(drops, F.lit(1))), (drops > 0) | cheaper, drops),
        feature("typical_dom", 10, typical, F.format_string("%.0f", days)),
        feature("too_fast", -30, days < cfg.vanish_too_fast_days, F.format_string("%.1f", days)),
        feature("alive_elsewhere", -25, c("active_on_other_sources") > 0, c("active_on_other_sources")),
        feature("agency_bulk", -15, c("agency_bulk_delist"), F.lit("bulk")),
        feature("relisted", -35, c("relisted_soon"), F.lit("relisted")),
    ), lambda f: f.isNotNull())
    total = F.aggregate("features", F.lit(0), lambda acc, f: acc + f["points"])
    return (
        candidates.withColumn("features", features)
        .withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), total)))
        .withColumn("bucket", bucket_of(F.col("score"), cfg))
    )


def bulk_delist(listings: DataFrame, as_of: Column, cfg: MarketConfig = DEFAULT) -> DataFrame:
    """(agency, source) pairs with many listings vanished within a day."""
    recent = (F.col("status") == "vanished") & (F.col("vanished_at") >= since(as_of, cfg.bulk_delist_hours))
    return (
        listings.where(recent & (blank_safe(F.col("agency")) != ""))
        .groupBy("agency", "source").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= cfg.bulk_delist_min)
    )


def deal_candidates(
    listings: DataFrame, events: DataFrame, as_of: Column, cfg: MarketConfig = DEFAULT, everyone: DataFrame | None = None,
) -> DataFrame:
    """One scoring input per premises whose listings have all gone.

    ``everyone`` is the whole listing table when ``listings`` holds some premises only.
    """
    sets = source_sets(listings).where(F.col("active_listings") == 0)
    low = F.lower(blank_safe(F.col("source_status_raw")))
    explicit = any_contains(low, rules.EXPLICIT_DEAL_WORDS)
    marked = F.when(explicit & any_contains(low, rules.SOLD_STEMS), "sold_marked").when(
        explicit & any_contains(low, rules.RENTED_STEMS), "rented_marked").otherwise(F.col("status"))
    back = relisted_properties(events, as_of, cfg.relisted_soon_days).withColumn("_back", F.lit(True))
    rows = (
        representative(listings).join(sets, "property_key")
        .join(previous_price(events), KEY, "left").join(back, "property_key", "left")
    )
    rows = lookup_join(rows, bulk_delist(listings if everyone is None else everyone, as_of, cfg).withColumn("_bulk", F.lit(True)), ["agency", "source"], "n")
    return rows.select(
        "property_key", *KEY, "deal_type", F.coalesce("vanished_at", as_of).alias("vanished_at"), "first_seen_at",
        F.col("price").alias("last_price"), "previous_price", "price_drop_count",
        F.lit(0).alias("active_on_other_sources"), F.size("vanished_sources").alias("vanished_on_sources"),
        F.size("tracked_sources").alias("tracked_sources_n"), explicit.alias("explicit_sold_or_rented"),
        F.coalesce("_bulk", F.lit(False)).alias("agency_bulk_delist"),
        F.coalesce("_back", F.lit(False)).alias("relisted_soon"), marked.alias("new_status"),
    )


def rescore_all(listings: DataFrame, events: DataFrame, as_of: Column, cfg: MarketConfig = DEFAULT) -> DataFrame:
    """Scored hypotheses of every premises that is gone, all at once."""
    return score_deals(deal_candidates(listings, events, as_of, cfg), cfg)


def apply_deal_marks(listings: DataFrame, scored: DataFrame) -> DataFrame:
    """Representative listings with an explicit status become sold or rented."""
    marks = scored.where(F.col("new_status") != "vanished").select(*KEY, "new_status")
    return listings.join(marks, KEY, "left").withColumn("status", F.coalesce("new_status", "status")).drop("new_status")


def latest_hypothesis(hyps: DataFrame) -> DataFrame:
    """Newest hypothesis of each premises."""
    return latest_by(hyps, ["property_key"], [F.col("created_at"), F.col("score")])


def merge_hypotheses(old: DataFrame, scored: DataFrame, as_of: Column) -> DataFrame:
    """Rewrites the newest hypothesis of a premises unless a human labelled it; else adds one."""
    cols = ["property_key", *KEY, "score", "bucket", "features", "human_label", "created_at", "updated_at"]
    def mark() -> Column:
        return F.struct("created_at", "score", *KEY)

    last = latest_by(old, ["property_key"], [mark()]).select("property_key", mark().alias("_last"), F.col("human_label").alias("_label"))
    fresh = scored.select("property_key", *[F.col(c).alias(f"_n_{c}") for c in (*KEY, "score", "bucket", "features")])
    rewritten = old.join(last, "property_key", "left").join(fresh, "property_key", "left")
    replace = mark().eqNullSafe(F.col("_last")) & F.col("_label").isNull() & F.col("_n_score").isNotNull()
    new_value = lambda c: F.when(replace, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c)
    kept = rewritten.select(
        "property_key", *[new_value(c) for c in (*KEY, "score", "bucket", "features")], "human_label", "created_at",
        F.when(replace, as_of).otherwise(F.col("updated_at")).alias("updated_at"),
    )
    open_ = last.where(F.col("_label").isNull()).select("property_key")
    added = scored.join(open_, "property_key", "left_anti").select(
        "property_key", *KEY, "score", "bucket", "features", F.lit(None).cast("string").alias("human_label"),
        as_of.alias("created_at"), as_of.alias("updated_at"),
    )
    return kept.select(*cols).unionByName(added.select(*cols))


def apply_labels(hyps: DataFrame, labels: DataFrame) -> DataFrame:
    """Human labels ``(property_key, created_at, human_label)`` written into the hypotheses."""
    valid = labels.where(F.col("human_label").isin(*HUMAN_LABELS)).select(
        "property_key", "created_at", F.col("human_label").alias("_label"))
    return hyps.join(valid, ["property_key", "created_at"], "left").withColumn(
        "human_label", F.coalesce("_label", "human_label")).drop("_label")


def hypotheses_for(hyps: DataFrame, listings: DataFrame, deal_type: str) -> DataFrame:
    """Hypotheses whose listing has the deal type."""
    side = listings.where(F.col("deal_type") == deal_type).select(*KEY, "deal_type")
    return attach(hyps, side, KEY)


def _windowed(hyps: DataFrame, as_of: Column, hours: int | None) -> DataFrame:
    return hyps.where(F.col("created_at") >= since(as_of, hours)) if hours else hyps


def bucket_counts(hyps: DataFrame, listings: DataFrame, deal_type: str, as_of: Column, hours: int | None = 168) -> DataFrame:
    """Hypotheses per bucket and in total (``all``); empty buckets count zero."""
    rows = _windowed(hyps, as_of, hours).join(listings.where(F.col("deal_type") == deal_type).select(*KEY), KEY, "left_semi")
    totals = rows.agg(*[F.count_if(F.col("bucket") == b).alias(b) for b in BUCKETS], F.count(F.lit(1)).alias("all"))
    pairs = [x for b in (*BUCKETS, "all") for x in (F.lit(b), F.col(b))]
    return totals.select(F.explode(F.create_map(*pairs)).alias("bucket", "n"))


def top_deals(
    hyps: DataFrame, listings: DataFrame, deal_type: str, as_of: Column, bucket: str | None = "likely_deal",
    hours: int | None = 168, limit: int = 5,
) -> DataFrame:
    """Best scored hypotheses of a deal type, newest first among equals."""
    rows = _windowed(hyps, as_of, hours)
    if bucket:
        rows = rows.where(F.col("bucket") == bucket)
    rows = rows.join(listings.where(F.col("deal_type") == deal_type).select(*KEY), KEY, "left_semi")
    return rows.orderBy(F.col("score").desc(), F.col("created_at").desc(), "property_key").limit(limit)


def deal_cards(hyps: DataFrame, properties: DataFrame, listings: DataFrame) -> DataFrame:
    """Hypothesis with its premises and listing; a missing listing falls back to the last seen one."""
    own = listings.select(*KEY, F.struct(*[c for c in listings.columns]).alias("_own"))
    latest = latest_by(listings, ["property_key"], [F.col("last_seen_at"), *[F.col(c) for c in KEY]])
    fallback = latest.select("property_key", F.struct(*[F.col(c) for c in listings.columns]).alias("_fallback"))
    known = properties.select(F.col("fingerprint").alias("property_key"), F.struct(*properties.columns).alias("property"))
    return (
        hyps.join(known, "property_key", "left").join(own, KEY, "left").join(fallback, "property_key", "left")
        .withColumn("listing", F.coalesce("_own", F.when(F.col("property").isNotNull(), F.col("_fallback"))))
        .drop("_own", "_fallback")
    )
