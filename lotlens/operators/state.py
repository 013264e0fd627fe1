"""Keyed state of the mart: upsert of a batch, vanish guard and vanish events."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotlens.config import DEFAULT, MarketConfig
from lotlens.functions.money import normalize_price, null_bad_price, suspicious_rate, with_effective_rate, with_sane_rate
from lotlens.functions.identity import with_fingerprint
from lotlens.functions.segments import classify_segment
from lotlens.functions import rules
from lotlens.functions.text import (
    blank_safe, cap_rate, detect_opex, join_text, map_status, net_operating_income,
    none_if_empty, normalize_address, strip_price_junk,
)
from lotlens.operators.activity import last_reactivation, representative
from lotlens.operators.changes import KEY, STICKY, card_changed, dedupe_batch, track_observations
from lotlens.operators.market import is_active
from lotlens.operators.relational import HOT_ROWS, append_key, checked_broadcast
from lotlens.schemas import CARD_COLUMNS, EXTRA, PAYLOAD
from lotlens.session import stored

TRUTHY = ("title", "description", "currency", "address_raw", "district", "city", "phone", "agency",
          "source_status_raw", "property_type")
NUMERIC = ("price", "area_sqm", "floor", "lat", "lon")
EXTRA_FIELDS = [part.strip().split()[0] for part in EXTRA[len("STRUCT<"):-1].split(",")]
JUNK_TITLE_SOURCE = "rieltor"
DEFAULT_CITY = "Київ"


def _extra_with(extra: Column, **changes: Column) -> Column:
    """The extra struct with some fields replaced."""
    return F.struct(*[changes.get(f, extra[f]).alias(f) for f in EXTRA_FIELDS])


def apply_exclusion(suspicious: Column, excluded: Column, extra: Column) -> tuple[Column, Column]:
    """Automatic stats exclusion: (flag, auto marker). Human decisions stay as they are."""
    ruled = F.coalesce(extra["stats_review_ok"], F.lit(False)) | F.coalesce(extra["stats_exclude_manual"], F.lit(False))
    flag = F.when(ruled, F.coalesce(excluded, F.lit(False))).otherwise(suspicious)
    auto = F.when(ruled, extra["stats_auto_excluded"]).when(suspicious, True)
    return flag, auto


def set_exclusion(listings: DataFrame, overrides: DataFrame) -> DataFrame:
    """Human stats decisions ``(source, external_id, exclude)`` written into the listings."""
    joined = listings.join(overrides.select(*KEY, F.col("exclude").alias("_ex")), KEY, "left")
    on, off = F.col("_ex"), ~F.col("_ex")
    extra = F.col("raw_extra")
    none = F.lit(None).cast("boolean")
    changed = _extra_with(
        extra,
        stats_review_ok=F.when(on, none).when(off, True),
        stats_exclude_manual=F.when(on, F.lit(True)),
        stats_auto_excluded=none,
    )
    return joined.withColumns({
        "exclude_from_stats": F.coalesce("_ex", "exclude_from_stats"),
        "raw_extra": F.when(F.col("_ex").isNull(), extra).otherwise(changed),
    }).drop("_ex")


def clean_observations(obs: DataFrame, cfg: MarketConfig = DEFAULT) -> DataFrame:
    """Batch de-dup, segment filter, price repair, finance terms and fingerprint."""
    return clean_cards(dedupe_batch(obs), cfg)


def clean_cards(obs: DataFrame, cfg: MarketConfig = DEFAULT) -> DataFrame:
    """`clean_observations` for all cards of a listing, not the first one alone."""
    rows = classify_segment(obs).where(F.col("segment_decision.relevant"))
    segment = F.col("segment_decision.segment")
    rows = rows.withColumns({
        "property_type": F.when(segment.isin(*rules.TARGET_SEGMENTS), segment).otherwise(F.col("property_type")),
        "price": null_bad_price(F.col("price"), cfg),
    }).drop("segment_decision")
    rows = normalize_price(rows, "_norm", cfg)
    currency = F.coalesce(F.col("_norm.currency"), F.col("currency"))
    rows = rows.withColumns({"price": F.col("_norm.price"), "currency": currency})
    text = join_text(F.col("title"), F.col("description"))
    extra, was_rate = F.col("extra"), F.col("_norm.reinterpreted")
    rows = with_sane_rate(rows.withColumn("_nrate", F.col("_norm.price_per_sqm")), "price_per_sqm", "_nrate", "currency", cfg)
    rows = rows.withColumns({
        "extra": _extra_with(
            extra,
            cap_rate_pct=F.coalesce(cap_rate(text), extra["cap_rate_pct"]),
            noi=F.coalesce(net_operating_income(text), extra["noi"]),
            opex=F.when(F.col("deal_type") == "rent", detect_opex(F.col("title"), F.col("description"))).otherwise(extra["opex"]),
            price_was_psm=F.when(was_rate, True).otherwise(extra["price_was_psm"]),
            price_norm=F.when(was_rate, F.col("_norm.detail")).otherwise(extra["price_norm"]),
        ),
        "title": F.when(F.col("source") == JUNK_TITLE_SOURCE, strip_price_junk(F.col("title"))).otherwise(F.col("title")),
    }).drop("_norm", "_nrate")
    return with_fingerprint(rows, "property_key")


def merge_state(listings: DataFrame, batch: DataFrame, cfg: MarketConfig = DEFAULT) -> DataFrame:
    """Full outer merge of cleaned observations into the listings.

    Result: the new listing columns plus ``old`` (struct, null for new listings), ``new``
    (struct, null for unseen ones); `next_listings`, `merge_events` and `merge_snapshots`
    read it.
    """
    old = listings.select(*KEY, F.struct(*listings.columns).alias("old"))
    new = batch.select(*KEY, F.struct(*batch.columns).alias("new"))
    return old.join(new, KEY, "full")


def _old(c: str) -> Column:
    return F.col(f"old.{c}")


def _new(c: str) -> Column:
    return F.col(f"new.{c}")


def _raw_status() -> Column:
    return F.coalesce(none_if_empty(_new("source_status_raw")), _old("source_status_raw"))


def _price_moved() -> Column:
    return F.coalesce(_new("price") != _old("price"), F.lit(False))


def next_listings(merged: DataFrame, cfg: MarketConfig = DEFAULT) -> DataFrame:
    """Listing table after the batch: sticky columns keep old values, others take the new ones."""
    seen, known = F.col("new").isNotNull(), F.col("old").isNotNull()
    status = map_status(_raw_status())
    folded = "price_drops" in merged.schema["new"].dataType.names
    dropped = F.coalesce(_new("price_drops") if folded else (_new("price") < _old("price")).cast("int"), F.lit(0))
    first_seen = _new("first_seen_at") if folded else _new("seen_at")
    kept = F.when(_old("status") != "vanished", _old("vanished_at"))
    gone_at = F.when(status != "vanished", kept).when(
        known & (_old("status") != "vanished"), F.coalesce(_old("vanished_at"), _new("seen_at"))
    ).otherwise(_new("seen_at"))
    value: dict[str, Column] = {c: F.coalesce(_new(c), _old(c)) for c in CARD_COLUMNS}
    value |= {c: F.coalesce(none_if_empty(_new(c)), _old(c)) for c in TRUTHY}
    value |= {c: F.coalesce(_new(c), _old(c)) for c in NUMERIC}
    value["price_per_sqm"] = F.coalesce(F.when(_new("price_per_sqm") != 0, _new("price_per_sqm")), _old("price_per_sqm"))
    value["rooms"] = F.when(known, _old("rooms")).otherwise(_new("rooms"))
    value["raw_extra"] = F.struct(*[
        F.coalesce(F.col(f"new.extra.{f}"), F.col(f"old.raw_extra.{f}")).alias(f) for f in EXTRA_FIELDS
    ])
    value["property_key"] = F.coalesce(_new("property_key"), _old("property_key"))
    value["status"] = F.when(seen, status).otherwise(_old("status"))
    value["first_seen_at"] = F.coalesce(_old("first_seen_at"), first_seen)
    value["last_seen_at"] = F.coalesce(_new("seen_at"), _old("last_seen_at"))
    value["vanished_at"] = F.when(seen, gone_at).otherwise(_old("vanished_at"))
    value["price_drop_count"] = (F.coalesce(_old("price_drop_count"), F.lit(0)) + dropped).cast("int")
    value["exclude_from_stats"] = F.coalesce(_old("exclude_from_stats"), F.lit(False))
    value["created_at"] = F.coalesce(_old("created_at"), first_seen)
    value["updated_at"] = F.coalesce(_new("seen_at"), _old("updated_at"))
    rows = merged.select(seen.alias("_seen"), *[
        v.alias(k) for k, v in value.items() if k not in KEY
    ], *KEY)
    rows = with_effective_rate(rows, "_rate", cfg)
    odd = suspicious_rate(F.col("_rate"), F.col("deal_type"), cfg)
    flag, auto = apply_exclusion(F.col("_odd"), F.col("exclude_from_stats"), F.col("raw_extra"))
    marked = _extra_with(F.col("raw_extra"), price_suspicious=F.when(F.col("_odd"), True), stats_auto_excluded=auto)
    out = [*CARD_COLUMNS, "raw_extra", "property_key", "status", "first_seen_at", "last_seen_at", "vanished_at",
           "price_drop_count", "exclude_from_stats", "created_at", "updated_at"]
    return (
        rows.withColumn("_odd", odd)
        .withColumns({
            "exclude_from_stats": F.when(F.col("_seen"), flag).otherwise(F.col("exclude_from_stats")),
            "raw_extra": F.when(F.col("_seen"), marked).otherwise(F.col("raw_extra")),
        })
        .select(*out)
    )


def _payload(**fields: Column) -> Column:
    """Event payload struct; fields not given are null."""
    names = [p.strip().split(" ", 1) for p in PAYLOAD[len("STRUCT<"):-1].split(", ")]
    return F.struct(*[fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in names])


def mart_events(changes: DataFrame) -> DataFrame:
    """Change events with the columns and the payload of the events table."""
    payload = _payload(**{n: F.col(f"payload.{n}") for n in changes.schema["payload"].dataType.names})
    return changes.select("event_id", "property_key", *KEY, "event_type", "occurred_at", payload.alias("payload"))


def merge_events(merged: DataFrame) -> DataFrame:
    """appeared, relisted, price_changed and status_changed events of a merged batch."""
    known = F.col("old").isNotNull()
    back = known & (_old("status") == "vanished")
    before = F.when(back, "relisted").otherwise(_old("status"))
    status = map_status(_raw_status())
    turned = known & (status != "active") & (status != before)
    make = lambda kind, when, payload: F.when(when, F.struct(F.lit(kind).alias("event_type"), payload.alias("payload")))
    events = F.filter(F.array(
        make("appeared", ~known, _payload(source=F.col("source"), url=_new("url"))),
        make("relisted", back, _payload(previous_vanished_at=_old("vanished_at"))),
        make("price_changed", _price_moved(), _payload(
            old_price=_old("price"), new_price=_new("price"),
            currency=F.coalesce(none_if_empty(_new("currency")), _old("currency")))),
        make("status_changed", turned, _payload(old_status=before, new_status=status, source_status_raw=_raw_status())),
    ), lambda e: e.isNotNull())
    fired = merged.where(F.col("new").isNotNull()).select(
        _new("property_key").alias("property_key"), *KEY, _new("seen_at").alias("occurred_at"), F.explode(events).alias("_e")
    )
    return fired.select(
        append_key(*[F.col(c) for c in KEY], F.col("_e.event_type"), F.col("occurred_at")).alias("event_id"),
        "property_key", *KEY, "_e.event_type", "occurred_at", "_e.payload",
    )


def track_cards(listings: DataFrame, cards: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """All cards of a batch with the state each one met; the stored listing comes first, whatever its time."""
    first = cards.groupBy(*KEY).agg(F.min("seen_at").alias("_first"))
    fresh = cards.select(*KEY, "property_key", "url", *STICKY, "seen_at", "seq").withColumns({
        "stored": F.lit("card"), "stored_gone": F.lit(None).cast("timestamp")})
    seeds = listings.join(first, KEY).select(
        *KEY, "property_key", "url", *STICKY, F.least("last_seen_at", "_first").alias("seen_at"),
        F.lit(-(2**63)).cast("bigint").alias("seq"), F.col("status").alias("stored"), F.col("vanished_at").alias("stored_gone"))
    rows = track_observations(seeds.unionByName(fresh), hot_rows=hot_rows, also=["stored", "stored_gone"])
    met = F.col("prev_stored") != "card"
    return rows.where("stored = 'card'").withColumns({
        "stored_status": F.when(met, F.col("prev_stored")).otherwise(F.col("stored_status")),
        "stored_vanished_at": F.when(met, F.col("prev_stored_gone")).otherwise(F.col("stored_vanished_at")),
    })


def fold_cards(cards: DataFrame, tracked: DataFrame) -> DataFrame:
    """One row per listing that merges into the stored state as its cards would one after the other."""
    place = F.struct("seen_at", "seq")

    def last(value: Column, kept: Column) -> Column:
        return F.max_by(value, F.when(kept, place))

    picked = {c: last(F.col(c), F.col(c).isNotNull()) for c in CARD_COLUMNS if c not in KEY}
    picked |= {c: last(F.col(c), none_if_empty(F.col(c)).isNotNull()) for c in TRUTHY}
    picked["price_per_sqm"] = last(F.col("price_per_sqm"), F.col("price_per_sqm") != 0)
    picked["rooms"] = F.min_by("rooms", place)
    picked["extra"] = F.struct(*[last(F.col(f"extra.{f}"), F.col(f"extra.{f}").isNotNull()).alias(f) for f in EXTRA_FIELDS])
    folded = cards.groupBy(*KEY).agg(
        *[v.alias(c) for c, v in picked.items()], F.max_by("property_key", place).alias("property_key"),
        F.min("seen_at").alias("first_seen_at"), F.max("seen_at").alias("seen_at"), F.max_by("seq", place).alias("seq"))
    drops = tracked.where("price_dropped").groupBy(*KEY).agg(F.count(F.lit(1)).cast("int").alias("price_drops"))
    return folded.join(drops, KEY, "left")


def merge_snapshots(merged: DataFrame, listings_after: DataFrame) -> DataFrame:
    """History rows of a merged batch: new listings and those whose card or text changed."""
    described = blank_safe(_new("description"))
    gate = F.col("old").isNull() | card_changed(_new, _old) | (
        (described != "") & (F.trim(described) != F.trim(blank_safe(_old("description"))))
    ) | ((blank_safe(_new("phone")) != "") & (blank_safe(_old("phone")) == "")) | (_old("status") == "vanished")
    changed = merged.where(F.col("new").isNotNull() & gate).select(
        *KEY, _new("seen_at").alias("crawled_at"), F.to_json(F.col("new")).alias("payload"))
    after = listings_after.select(*KEY, "price", "currency", "status", "title", "area_sqm")
    return changed.join(after, KEY).select(
        *KEY, "crawled_at", "price", "currency", "status", "title", "area_sqm", "payload")


def merge_properties(properties: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(properties after the batch, property-level appeared events).

    The first observation of a fingerprint fills a new row; known ones get their last seen
    time, the active flag and a missing title or district.
    """
    seq = F.struct("seen_at", "seq")
    first = lambda c: F.min_by(F.col(c), seq)
    named = lambda c: F.min_by(F.col(c), F.when(blank_safe(F.col(c)) != "", seq))
    fresh = batch.groupBy(F.col("property_key").alias("fingerprint")).agg(
        named("title").alias("_title"), named("district").alias("_district"),
        normalize_address(first("address_raw")).alias("_address"),
        *[first(c).alias(f"_{c}") for c in ("city", "property_type", "deal_type", "area_sqm", "floor", "lat", "lon", "source", "external_id")],
        F.min("seen_at").alias("_first"), F.max("seen_at").alias("_last"),
    )
    joined = properties.withColumn("_known", F.lit(True)).join(fresh, "fingerprint", "full")
    known, seen = F.col("_known").isNotNull(), F.col("_first").isNotNull()
    take = lambda c: F.when(known, F.col(c)).otherwise(F.col(f"_{c}")).alias(c)
    after = joined.select(
        "fingerprint", F.coalesce(none_if_empty(F.col("title")), "_title").alias("title"),
        F.when(known, F.col("address_norm")).otherwise(F.col("_address")).alias("address_norm"),
        F.coalesce(none_if_empty(F.col("district")), "_district").alias("district"),
        F.when(known, F.col("city")).otherwise(F.coalesce(none_if_empty(F.col("_city")), F.lit(DEFAULT_CITY))).alias("city"),
        "region", *[take(c) for c in ("property_type", "deal_type", "area_sqm", "floor", "lat", "lon")],
        F.coalesce("first_seen_at", "_first").alias("first_seen_at"),
        F.coalesce("_last", "last_seen_at").alias("last_seen_at"),
        F.when(seen, True).otherwise(F.col("is_active")).alias("is_active"),
        F.coalesce("created_at", "_first").alias("created_at"), F.coalesce("_last", "updated_at").alias("updated_at"),
    )
    born = joined.where(~known).select(
        append_key(F.col("fingerprint"), F.lit("appeared"), F.col("_first")).alias("event_id"),
        F.col("fingerprint").alias("property_key"), F.lit(None).cast("string").alias("source"),
        F.lit(None).cast("string").alias("external_id"), F.lit("appeared").alias("event_type"),
        F.col("_first").alias("occurred_at"),
        _payload(source=F.col("_source"), external_id=F.col("_external_id")).alias("payload"),
    )
    return after, born


def new_fingerprints(batch: DataFrame, properties: DataFrame) -> DataFrame:
    """Fingerprints of a batch that no premises carry yet."""
    return batch.select(F.col("property_key").alias("fingerprint")).distinct().join(
        properties.select("fingerprint"), "fingerprint", "left_anti")


# --- vanish ---------------------------------------------------------------------------------


def coverage_guard(seen: DataFrame, listings: DataFrame, cfg: MarketConfig = DEFAULT) -> DataFrame:
    """Per source: may unseen listings be declared vanished? (seen, active, allowed, reason)."""
    counts = seen.groupBy("source").agg(F.count_distinct("external_id").alias("seen"))
    base = listings.where(is_active()).groupBy("source").agg(F.count(F.lit(1)).alias("active"))
    n, total = F.coalesce("seen", F.lit(0)), F.coalesce("active", F.lit(0))
    ratio = n / total
    share = F.format_string("%.2f%%", ratio * 100)
    reason = (
        F.when(n <= 0, "seen=0")
        .when(n < cfg.min_seen_for_vanish, F.format_string(f"seen=%d < min={cfg.min_seen_for_vanish}", n))
        .when(total <= 0, F.format_string("no active baseline, seen=%d", n))
        .when(ratio < cfg.vanish_min_active_ratio,
              F.concat(F.lit("seen/active="), share, F.lit(f" < {cfg.vanish_min_active_ratio * 100:.0f}% (partial crawl?)")))
        .otherwise(F.concat(F.format_string("seen=%d, active=%d, ratio=", n, total), share))
    )
    allowed = (n >= cfg.min_seen_for_vanish) & (n > 0) & ((total <= 0) | (ratio >= cfg.vanish_min_active_ratio))
    return counts.join(base, "source", "full").select(
        "source", n.alias("seen"), total.alias("active"), F.coalesce(allowed, F.lit(False)).alias("allowed"), reason.alias("reason"))


def missing_listings(
    listings: DataFrame, seen: DataFrame, as_of: Column, guard: DataFrame | None = None,
    grace_hours: int = DEFAULT.vanish_grace_hours,
) -> DataFrame:
    """Active listings past their grace time that the crawl did not see."""
    late = listings.where(is_active() & (F.col("last_seen_at") < as_of - F.expr(f"INTERVAL {grace_hours} HOURS")))
    if guard is not None:
        allowed = checked_broadcast(stored(guard.where("allowed").select("source"), "allowed"))  # one row per source
        late = late.join(allowed, "source", "left_semi")
    return late.join(seen.select(*KEY).distinct(), KEY, "left_anti")


def mark_vanished(
    listings: DataFrame, seen: DataFrame, as_of: Column, guard: DataFrame | None = None,
    grace_hours: int = DEFAULT.vanish_grace_hours,
) -> DataFrame:
    """Listing table with missing listings set to vanished; ``newly_vanished`` marks them."""
    gone = missing_listings(listings, seen, as_of, guard, grace_hours).select(*KEY, F.lit(True).alias("_gone"))
    hit = F.col("_gone").isNotNull()
    return listings.join(gone, KEY, "left").withColumns({
        "status": F.when(hit, "vanished").otherwise(F.col("status")),
        "vanished_at": F.when(hit, as_of).otherwise(F.col("vanished_at")),
        "newly_vanished": hit,
    }).drop("_gone")


def source_sets(listings: DataFrame) -> DataFrame:
    """Per premises: active count, tracked sources and sources where it vanished."""
    vanished = F.when(F.col("status") == "vanished", F.col("source"))
    return listings.groupBy("property_key").agg(
        F.count_if(is_active()).alias("active_listings"),
        F.array_sort(F.collect_set("source")).alias("tracked_sources"),
        F.array_sort(F.collect_set(vanished)).alias("vanished_sources"),
    )


def gone_everywhere(sets: DataFrame) -> DataFrame:
    """Premises that vanished from every source that tracked them."""
    left = F.array_except(F.col("tracked_sources"), F.col("vanished_sources"))
    return sets.where((F.size("vanished_sources") > 0) & (F.size(left) == 0))


def vanish_events(
    listings: DataFrame, events: DataFrame, as_of: Column, touched: DataFrame | None = None
) -> DataFrame:
    """One vanished event per premises without active listings, once per episode."""
    sets = source_sets(listings).where(F.col("active_listings") == 0)
    if touched is not None:
        sets = sets.join(touched.select("property_key").distinct(), "property_key", "left_semi")
    gone = events.where((F.col("event_type") == "vanished") & F.col("property_key").isNotNull()).groupBy(
        "property_key").agg(F.max("occurred_at").alias("_gone_at"))
    told = gone.join(last_reactivation(events), "property_key", "left").where(
        F.col("reactivated_at").isNull() | (F.col("_gone_at") >= F.col("reactivated_at")))
    reps = representative(listings).select("property_key", *KEY)
    return sets.join(told.select("property_key"), "property_key", "left_anti").join(reps, "property_key").select(
        append_key(F.col("property_key"), F.lit("vanished"), as_of).alias("event_id"), "property_key", *KEY,
        F.lit("vanished").alias("event_type"), as_of.alias("occurred_at"),
        _payload(
            sources_vanished=F.col("vanished_sources"), trigger_source=F.col("source"),
            trigger_external_id=F.col("external_id"), level=F.lit("property"),
        ).alias("payload"),
    )


def refresh_active(properties: DataFrame, listings: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Active flag of premises = any active listing."""
    live = listings.groupBy(F.col("property_key").alias(key)).agg(F.bool_or(is_active()).alias("_live"))
    return properties.join(live, key, "left").withColumn("is_active", F.coalesce("_live", F.lit(False))).drop("_live")


@dataclass
class VanishResult:
    """Tables after one vanish pass over all sources."""

    guard: DataFrame
    listings: DataFrame
    new_events: DataFrame
    properties: DataFrame | None = None


def reconcile_vanish(
    listings: DataFrame, events: DataFrame, seen: DataFrame, as_of: Column,
    properties: DataFrame | None = None, cfg: MarketConfig = DEFAULT,
) -> VanishResult:
    """Guard, mark and emit for all sources at once; deal scoring follows on the result.

    The marked listings are written to the shared folder once, as each of the results reads them.
    """
    guard = coverage_guard(seen, listings, cfg)
    marked = stored(mark_vanished(listings, seen, as_of, guard, cfg.vanish_grace_hours), "marked")
    touched = marked.where("newly_vanished").select("property_key")
    fresh = vanish_events(marked.drop("newly_vanished"), events, as_of, touched)
    after = None if properties is None else refresh_active(properties, marked)
    return VanishResult(guard, marked, fresh, after)
