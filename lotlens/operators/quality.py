"""Data-quality reports, work lists and maintenance jobs over the whole mart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotlens.config import DEFAULT, MarketConfig
from lotlens.functions.money import (
    normalize_price, null_bad_price, suspicious_rate, to_usd, with_effective_rate, with_sane_rate,
)
from lotlens.functions.rules import TARGET_SEGMENTS
from lotlens.functions.segments import classify_segment
from lotlens.functions.text import blank_safe, computed_once, detect_opex, in_region, strip_price_junk
from lotlens.operators.changes import KEY, card_changed
from lotlens.operators.market import is_active
from lotlens.operators.relational import top_n_per_group
from lotlens.session import stored
from lotlens.operators.state import JUNK_TITLE_SOURCE, _extra_with, apply_exclusion
from lotlens.sources.versions import VersionedTables

REGION_SOURCE = "domria"


def long_counts(df: DataFrame, *names: str) -> DataFrame:
    """One row of counters as (metric, n) rows."""
    pairs = [x for n in names for x in (F.lit(n), F.col(n).cast("bigint"))]
    return df.select(F.explode(F.create_map(*pairs)).alias("metric", "n"))


def table_totals(listings: DataFrame, properties: DataFrame, hypotheses: DataFrame, events: DataFrame) -> DataFrame:
    """Row counts of the mart, by source and by segment: (grp, name, n)."""
    def one(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.lit("total").alias("grp"), F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))

    flags = listings.agg(
        F.count(F.lit(1)).alias("listings"), F.count("price").alias("with_price"),
        F.count_if(F.col("status") == "active").alias("active"),
        F.count_if(F.col("status") == "vanished").alias("vanished"),
    )
    totals = long_counts(flags, "listings", "with_price", "active", "vanished").select(
        F.lit("total").alias("grp"), F.col("metric").alias("name"), "n")
    out = totals
    for part in (one(properties, "properties"), one(hypotheses, "hypotheses"), one(events, "events")):
        out = out.unionByName(part)
    for grp, col in (("source", "source"), ("segment", "property_type")):
        out = out.unionByName(listings.groupBy(F.lit(grp).alias("grp"), F.col(col).alias("name")).agg(F.count(F.lit(1)).alias("n")))
    return out


def price_audit(listings: DataFrame, cfg: MarketConfig = DEFAULT) -> DataFrame:
    """Counters of common price faults, one pass: (metric, n)."""
    c = F.col
    live = is_active()
    rate, price, area = c("_rate"), c("price"), c("area_sqm")
    known = price.isNotNull() & area.isNotNull()
    flags = {
        "active_listings": live,
        "sale_psm_out_of_band": live & known & (c("deal_type") == "sale") & ((rate < cfg.sale_psm_min) | (rate > cfg.sale_psm_max)),
        "rent_psm_over_ceiling": live & known & (c("deal_type") == "rent") & (rate > cfg.rent_psm_max),
        "junk_titles": live & (c("source") == JUNK_TITLE_SOURCE) & c("title").rlike(r"^[0-9][0-9] [0-9][0-9] "),
        "rate_equals_total": (area > 0) & (F.abs(c("price_per_sqm") - price) / F.greatest(price, F.lit(1.0)) < 0.02),
        "price_without_area": live & price.isNotNull() & area.isNull(),
        "out_of_region": live & (c("source") == REGION_SOURCE) & (blank_safe(c("url")) != "") & ~in_region(c("url")),
        "flagged_suspicious": (c("deal_type") == "rent") & c("raw_extra.price_suspicious"),
    }
    counted = with_effective_rate(listings, "_rate", cfg).agg(*[F.count_if(F.coalesce(f, F.lit(False))).alias(n) for n, f in flags.items()])
    return long_counts(counted, *flags)


def batch_summary(merged: DataFrame, seen: DataFrame, relevant: DataFrame, snapshots: DataFrame, marked: DataFrame) -> DataFrame:
    """Per source: seen, unique, with price, upserted, irrelevant, snapshots written, vanished."""
    unique = seen.groupBy(*KEY).agg(F.max(F.col("price").isNotNull().cast("int")).alias("_priced"))
    parts = [
        unique.groupBy("source").agg(F.count(F.lit(1)).alias("seen"), F.sum("_priced").alias("with_price")),
        relevant.select(*KEY).distinct().groupBy("source").agg(F.count(F.lit(1)).alias("upserted")),
        snapshots.groupBy("source").agg(F.count(F.lit(1)).alias("snapshots")),
        marked.where("newly_vanished").groupBy("source").agg(F.count(F.lit(1)).alias("vanished")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, "source", "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return out.select(
        "source", n("seen").alias("seen"), n("with_price").alias("with_price"), n("upserted").alias("upserted"),
        (n("seen") - n("upserted")).alias("skipped_irrelevant"), (n("upserted") - n("snapshots")).alias("snapshots_skipped"),
        n("vanished").alias("vanished"),
    )


def detail_worklist(batch: DataFrame, listings: DataFrame, per_source: int) -> DataFrame:
    """Cards that need their detail page, capped per source: new, changed or never enriched."""
    old = listings.select(*KEY, F.struct(*listings.columns).alias("old"))
    rows = batch.join(old, KEY, "left")
    was = lambda c: F.col(f"old.{c}")
    never = was("phone").isNull() & (F.trim(blank_safe(was("description"))) == "")
    stale = F.coalesce(F.col("old.raw_extra.skip_detail"), F.lit(False)) if "raw_extra" in listings.columns else F.lit(False)
    needed = F.col("old").isNull() | card_changed(F.col, was) | stale | never
    wanted = rows.where(needed)
    if "extra" in batch.columns:
        wanted = wanted.where(~F.coalesce(F.col("extra.skip_detail"), F.lit(False)))
    return top_n_per_group(wanted.drop("old"), ["source"], [F.col("seq"), F.col("external_id")], per_source, F.col("external_id"))


def refresh_worklist(listings: DataFrame, limit: int, min_sale: float = 10_000.0, cfg: MarketConfig = DEFAULT) -> DataFrame:
    """Active listings whose rate is implausibly high, for a price re-check."""
    rate = F.col("rate_usd")
    odd = ((F.col("deal_type") == "sale") & (rate >= min_sale)) | ((F.col("deal_type") == "rent") & (rate > cfg.rent_psm_max))
    rows = listings.where(is_active() & F.col("url").isNotNull() & (F.col("price") != 0) & (F.col("area_sqm") != 0))
    rated = computed_once(with_effective_rate(rows, "rate_usd", cfg), "rate_usd")
    return rated.where(odd).orderBy(*KEY).limit(limit)


# --- maintenance --------------------------------------------------------------------------------


def fix_prices(listings: DataFrame, statuses: list[str] | None = None, cfg: MarketConfig = DEFAULT) -> DataFrame:
    """Re-normalises prices as one projection; ``fix`` says what happened to a row."""
    rows = listings if statuses is None else listings.where(F.col("status").isin(*statuses))
    before = {c: F.col(f"_b_{c}") for c in ("price", "currency", "price_per_sqm", "title", "raw_extra", "exclude_from_stats")}
    rows = normalize_price(rows.withColumns({f"_b_{c}": F.col(c) for c in before}), "_norm", cfg, once=False)
    norm = lambda c: F.col(f"_norm.{c}")
    rows = rows.withColumns({
        "price": F.coalesce(norm("price"), F.col("price")), "currency": F.coalesce(norm("currency"), F.col("currency")),
    })
    rows = with_sane_rate(rows.withColumn("_nrate", norm("price_per_sqm")), "_sane_rate", "_nrate", "currency", cfg)
    rows = rows.withColumn("price_per_sqm", F.coalesce("_sane_rate", "_nrate", "price_per_sqm"))
    rows = with_effective_rate(rows, "_rate1", cfg)
    extra, detail = F.col("raw_extra"), norm("detail")
    moved = ~(
        F.col("price").eqNullSafe(before["price"]) & F.col("currency").eqNullSafe(before["currency"])
        & F.col("price_per_sqm").eqNullSafe(before["price_per_sqm"])
    )
    from_text = detail.isin("text_total_and_psm", "repair_absurd_from_text_psm")
    too_dear = F.col("_rate1") > cfg.rent_psm_max
    expanded_before = F.coalesce(extra["price_was_psm"], F.lit(False)) & (F.col("deal_type") == "rent")
    rollback = ~from_text & ~norm("reinterpreted") & expanded_before & F.coalesce(too_dear, F.lit(False))
    rate_usd = to_usd(F.col("price_per_sqm"), F.col("currency"), cfg)
    sane_rate = F.coalesce((rate_usd <= cfg.rent_psm_max) & (F.col("area_sqm") != 0), F.lit(False))
    rows = rows.withColumns({"_moved": moved, "_rollback": rollback, "_sane": sane_rate})
    back, sane = F.col("_rollback"), F.col("_sane")
    rows = rows.withColumns({
        "raw_extra": _extra_with(
            extra,
            price_was_psm=F.when(from_text | (back & ~sane), F.lit(None)).when(norm("reinterpreted"), True).otherwise(extra["price_was_psm"]),
            price_norm=F.when(from_text | norm("reinterpreted"), detail)
            .when(back & sane, "rollback_reexpand_sane_rate").when(back, "clear_bad_expand").otherwise(extra["price_norm"]),
        ),
        "price": F.when(back & sane, F.round(F.col("price_per_sqm") * F.col("area_sqm"), 2)).otherwise(F.col("price")),
    })
    rows = with_effective_rate(rows, "_rate2", cfg)
    rows = rows.withColumn("_odd", suspicious_rate(F.col("_rate2"), F.col("deal_type"), cfg) | norm("suspicious"))
    flag, auto = apply_exclusion(F.col("_odd"), F.col("exclude_from_stats"), F.col("raw_extra"))
    rows = rows.withColumns({
        "exclude_from_stats": flag,
        "raw_extra": _extra_with(F.col("raw_extra"), price_suspicious=F.when(F.col("_odd"), True), stats_auto_excluded=auto),
        "title": F.when(F.col("source") == JUNK_TITLE_SOURCE, strip_price_junk(F.col("title"))).otherwise(F.col("title")),
    })
    retitled = ~F.col("title").eqNullSafe(before["title"])
    fix = F.struct(
        (F.col("_moved") | retitled | ~F.col("raw_extra").eqNullSafe(before["raw_extra"])).alias("touched"),
        (F.col("_moved") & (detail == "text_total_and_psm")).alias("repaired_from_text"),
        (F.col("_moved") & (detail == "repair_absurd_from_text_psm")).alias("repaired_from_text_psm"),
        retitled.alias("title_cleaned"), detail.alias("detail"),
    )
    return rows.withColumn("fix", fix).select(*listings.columns, "fix")


def fix_summary(fixed: DataFrame) -> DataFrame:
    """(metric, n) of a price fix."""
    names = ["touched", "repaired_from_text", "repaired_from_text_psm", "title_cleaned"]
    return long_counts(fixed.agg(*[F.count_if(F.col(f"fix.{n}")).alias(n) for n in names]), *names)


def review_prices(listings: DataFrame, statuses: list[str] | None = None, cfg: MarketConfig = DEFAULT) -> DataFrame:
    """Audit, fix, audit again: (step, metric, n)."""
    fixed = fix_prices(listings, statuses, cfg)
    after = fixed.drop("fix")
    if statuses is not None:
        after = after.unionByName(listings.where(~F.coalesce(F.col("status").isin(*statuses), F.lit(False))))
    steps = (("before", price_audit(listings, cfg)), ("fix", fix_summary(fixed)), ("after", price_audit(after, cfg)))
    out = None
    for name, df in steps:
        rows = df.select(F.lit(name).alias("step"), "metric", "n")
        out = rows if out is None else out.unionByName(rows)
    return out


def orphans(properties: DataFrame, listings: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Premises without any listing."""
    owners = listings.select(F.col("property_key").alias(key)).distinct()
    return properties.join(owners, key, "left_anti")


CHILDREN = ("snapshots", "events", "hypotheses")


def bury_listings(mart: VersionedTables, batch: int, decided: DataFrame, changed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Cascading delete as batch ``batch``: listings, their children, and premises left without a listing.

    ``decided`` holds every listing's KEY, ``property_key`` and ``_gone``. Only keys are written; children are not read.
    ``changed`` holds rows of remaining listings with new values, put in place by the same commit.
    Returns the removed listings' keys and the fingerprints of the premises that went.
    """
    removed = stored(decided.where("_gone").select(*KEY).distinct(), "removed")
    owners = decided.where(~F.col("_gone")).select("property_key")
    lost = stored(orphans(mart.read("properties", before=batch).select("fingerprint"), owners), "lost")
    by_premises = lost.select(F.col("fingerprint").alias("property_key"))
    buried = {"listings": [removed], "properties": [lost]}
    for name in CHILDREN:
        buried[name] = [removed] if "property_key" not in mart.columns(name) else [removed, by_premises]
    parts = {}
    if changed is not None:
        new = stored(changed, "changed")
        touched = mart.touched("listings", new)
        old = mart.read("listings", touched, before=batch).join(new.select(*KEY).unionByName(removed), KEY, "left_anti")
        parts["listings"] = (old.unionByName(new), touched)
    mart.commit(batch, parts, buried=buried)
    return removed, lost


def clean_junk(mart: VersionedTables, batch: int, cfg: MarketConfig = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Removes out-of-region listings with their children and premises left alone, nulls bad prices; one commit."""
    rows = mart.read("listings", before=batch)
    gone = F.coalesce((F.col("source") == REGION_SOURCE) & (blank_safe(F.col("url")) != "") & ~in_region(F.col("url")), F.lit(False))
    decided = stored(rows.select(*KEY, "property_key", gone.alias("_gone")), "junk")
    price = null_bad_price(F.col("price"), cfg)
    return bury_listings(mart, batch, decided, rows.where(~gone & ~price.eqNullSafe(F.col("price"))).withColumn("price", price))


def reclassify(listings: DataFrame) -> DataFrame:
    """Every listing re-tagged with its segment; irrelevant ones go, ``retagged`` marks changes."""
    rows = classify_segment(listings).where(F.col("segment_decision.relevant"))
    segment = F.col("segment_decision.segment")
    return rows.withColumn("retagged", ~segment.eqNullSafe(F.col("property_type"))).withColumn(
        "property_type", segment).drop("segment_decision")


def prune_irrelevant(mart: VersionedTables, batch: int) -> tuple[DataFrame, DataFrame]:
    """Removes irrelevant listings with children and premises left alone; target segments re-tag the rest; one commit.

    The texts are classified once and the decisions stored.
    """
    rows = mart.read("listings", before=batch)
    segment = F.col("segment_decision.segment")
    decided = stored(classify_segment(rows).select(
        *KEY, "property_key", (~F.coalesce(F.col("segment_decision.relevant"), F.lit(False))).alias("_gone"),
        F.when(segment.isin(*TARGET_SEGMENTS), segment).alias("_tag"), F.col("property_type").alias("_was"),
    ), "segments")
    retagged = decided.where(~F.col("_gone") & F.col("_tag").isNotNull() & ~F.col("_tag").eqNullSafe(F.col("_was"))).select(*KEY, "_tag")
    changed = rows.join(retagged, KEY).withColumn("property_type", F.col("_tag")).select(*rows.columns)
    return bury_listings(mart, batch, decided, changed)


def backfill_opex(listings: DataFrame) -> DataFrame:
    """OPEX class of rent listings from their text, against the stored one."""
    found = detect_opex(F.col("title"), F.col("description"))
    rent = listings.where(F.col("deal_type") == "rent").withColumn("opex_found", found)
    return rent.withColumn("opex_updated", ~F.col("opex_found").eqNullSafe(F.col("raw_extra.opex")))


def opex_counts(backfilled: DataFrame) -> DataFrame:
    return backfilled.groupBy("opex_found").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("opex_updated")).alias("updated"))


def migrate_flags(listings: DataFrame) -> DataFrame:
    """Exclusion flag raised on rows whose stored marker says the price is suspicious."""
    marked = F.coalesce(F.col("raw_extra.price_suspicious"), F.lit(False))
    return listings.withColumn("exclude_from_stats", F.coalesce("exclude_from_stats", F.lit(False)) | marked)


def keep_in_region(df: DataFrame, url: Column | None = None) -> DataFrame:
    return df.where(in_region(F.col("url") if url is None else url))
