"""Change detection over an observation log: whole history in one pass, no per-row state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotlens.functions.text import blank_safe, map_status, none_if_empty
from lotlens.operators.relational import BROADCAST_ROWS, HOT_ROWS, append_key, earliest_by
from lotlens.operators.timeline import Timeline

KEY = ["source", "external_id"]
ORDER = ["seen_at", "seq"]
STICKY = ["price", "currency", "title", "area_sqm", "description", "phone", "source_status_raw"]


def dedupe_batch(obs: DataFrame) -> DataFrame:
    """First row per listing key of a batch, by sequence number."""
    return earliest_by(obs, KEY, [F.col("seq")])


def union_sources(*frames: DataFrame) -> DataFrame:
    """Observations of all sources as one batch; missing columns become null."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def approved_runs(obs: DataFrame, min_seen: int) -> DataFrame:
    """Daily crawl runs of a log that saw enough listings: (source, started_at, run_at, seen)."""
    day = F.date_trunc("day", F.col("seen_at"))
    return (
        obs.groupBy("source", day.alias("started_at"))
        .agg(F.count_distinct("external_id").alias("seen"))
        .where(F.col("seen") >= min_seen)
        .withColumn("run_at", F.col("started_at") + F.expr("INTERVAL 1 DAY"))
    )


def first_missing_run(
    rows: DataFrame, runs: DataFrame, seen: str, grace_hours: int, name: str = "missed_at"
) -> DataFrame:
    """Time of the first run that began after ``seen`` and ended past its grace time.

    A run settles all rows seen before ``limit = min(started_at, run_at - grace)``; the
    spans between limits are laid out by day, so the range lookup is an equi-join on
    (source, day). The run table has one row per source and run.
    """
    grace = F.expr(f"INTERVAL {grace_hours} HOURS")
    limits = runs.select(
        F.col("source").alias("_source"), F.col("run_at").alias("_run"),
        F.least("started_at", F.col("run_at") - grace).alias("_limit"),
    )
    spans = limits.withColumn("_from", F.lag("_limit").over(Window.partitionBy("_source").orderBy("_limit")))
    days = spans.where(F.col("_from").isNotNull()).withColumn(
        "_day", F.explode(F.sequence(F.to_date("_from"), F.to_date("_limit")))
    )
    opening = spans.where(F.col("_from").isNull()).select(
        "_source", F.col("_limit").alias("_open_limit"), F.col("_run").alias("_open_run")
    )
    if runs.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        days, opening = F.broadcast(days), F.broadcast(opening)
    t = F.col(seen)
    inside = (F.to_date(t) == F.col("_day")) & (t >= F.col("_from")) & (t < F.col("_limit"))
    found = F.when(t < F.col("_open_limit"), F.col("_open_run")).otherwise(F.col("_run"))
    return (
        rows.join(days, (rows["source"] == days["_source"]) & inside, "left").drop("_source")
        .join(opening, F.col("source") == F.col("_source"), "left")
        .select(*rows.columns, found.alias(name))
    )


def fill_blank(obs: DataFrame, columns) -> DataFrame:
    """Empty strings count as missing."""
    types = dict(obs.dtypes)
    return obs.withColumns({c: none_if_empty(F.col(c)) for c in columns if types[c] == "string"})


def _missed(rows: DataFrame, seen: str, runs: DataFrame | None, grace_hours: int, idle_hours: int | None, name: str) -> DataFrame:
    if runs is not None:
        return first_missing_run(rows, runs, seen, grace_hours, name)
    if idle_hours is not None:
        return rows.withColumn(name, F.col(seen) + F.expr(f"INTERVAL {idle_hours} HOURS"))
    return rows.withColumn(name, F.lit(None).cast("timestamp"))


def track_observations(
    obs: DataFrame, runs: DataFrame | None = None, grace_hours: int = 6, idle_hours: int | None = None,
    drop_counts: bool = False, hot_rows: int = HOT_ROWS, also: list[str] | None = None,
) -> DataFrame:
    """Every observation with the stored state it met.

    Adds previous values, the status before (``stored_status``) and after the observation
    (``mapped_status``), the time the listing had gone missing before (``stored_vanished_at``),
    ``price_dropped`` and, on demand, the running ``price_drop_count``. Absence comes from
    guarded crawl runs, or from a plain idle time in hours.
    """
    line = Timeline(fill_blank(obs, STICKY), KEY, ORDER, hot_rows)
    line.previous([*STICKY, "seen_at", *(also or [])])
    if drop_counts:
        line.running_count(F.col("price") < F.col("prev_price"), "price_drop_count")
    raw = F.coalesce("source_status_raw", "prev_source_status_raw")
    known = F.col("prev_seen_at").isNotNull()
    rows = line.frame().withColumns({
        "mapped_status": map_status(raw),
        "prev_mapped": F.when(known, map_status(F.col("prev_source_status_raw"))),
    })
    rows = _missed(rows, "prev_seen_at", runs, grace_hours, idle_hours, "_missed")
    missed = (F.col("prev_mapped") == "active") & (F.col("_missed") < F.col("seen_at"))
    return rows.withColumns({
        "stored_status": F.when(missed, "vanished").otherwise(F.col("prev_mapped")),
        "stored_vanished_at": F.when(missed, F.col("_missed")).when(
            F.col("prev_mapped") == "vanished", F.col("prev_seen_at")),
        "price_dropped": F.coalesce(F.col("price") < F.col("prev_price"), F.lit(False)),
    }).drop("_missed")


def _event(kind: str, when: Column, at: Column, **payload: Column) -> Column:
    fields = {
        "url": "string", "previous_vanished_at": "timestamp", "old_price": "double", "new_price": "double",
        "currency": "string", "old_status": "string", "new_status": "string", "source_status_raw": "string",
    }
    values = [payload.get(n, F.lit(None)).cast(t).alias(n) for n, t in fields.items()]
    return F.when(when, F.struct(F.lit(kind).alias("event_type"), at.alias("occurred_at"), F.struct(*values).alias("payload")))


def change_events(tracked: DataFrame) -> DataFrame:
    """appeared, relisted, price_changed and status_changed events of tracked observations."""
    known = F.col("prev_seen_at").isNotNull()
    relisted = known & (F.col("stored_status") == "vanished")
    before = F.when(relisted, "relisted").otherwise(F.col("stored_status"))
    moved = known & F.col("price").isNotNull() & (F.col("price") != F.col("prev_price"))
    turned = known & (F.col("mapped_status") != "active") & (F.col("mapped_status") != before)
    at = F.col("seen_at")
    url = F.col("url") if "url" in tracked.columns else F.lit(None)
    events = F.array(
        _event("appeared", ~known, at, url=url),
        _event("relisted", relisted, at, previous_vanished_at=F.col("stored_vanished_at")),
        _event(
            "price_changed", moved, at, old_price=F.col("prev_price"), new_price=F.col("price"),
            currency=F.coalesce("currency", "prev_currency"),
        ),
        _event(
            "status_changed", turned, at, old_status=before, new_status=F.col("mapped_status"),
            source_status_raw=F.coalesce("source_status_raw", "prev_source_status_raw"),
        ),
    )
    keep = [c for c in ("property_key", "deal_type", "district") if c in tracked.columns]
    fired = tracked.select(
        *KEY, *keep, F.explode(F.filter(events, lambda e: e.isNotNull())).alias("_e")
    ).select(*KEY, *keep, "_e.*")
    return fired.withColumn(
        "event_id", append_key(*[F.col(c) for c in KEY], F.col("event_type"), F.col("occurred_at"))
    )


def diff_observations(obs: DataFrame, runs: DataFrame | None = None, grace_hours: int = 6) -> DataFrame:
    """Change events of a whole observation log."""
    return change_events(track_observations(obs, runs, grace_hours))


def absence_events(tracked: DataFrame, state: DataFrame) -> DataFrame:
    """Listing-level vanished events: gaps before a return, and listings still gone."""
    keep = [c for c in ("property_key", "deal_type", "district") if c in tracked.columns]
    gaps = tracked.where((F.col("stored_status") == "vanished") & (F.col("prev_mapped") == "active")).select(
        *KEY, *keep, F.col("stored_vanished_at").alias("occurred_at"))
    open_ = state.where((F.col("status") == "vanished") & (map_status(F.col("source_status_raw")) == "active")).select(
        *KEY, *keep, F.col("vanished_at").alias("occurred_at"))
    rows = gaps.unionByName(open_).withColumn("event_type", F.lit("vanished"))
    return rows.withColumn(
        "event_id", append_key(*[F.col(c) for c in KEY], F.col("event_type"), F.col("occurred_at")))


def _differs(new: Column, old: Column) -> Column:
    """Numbers apart by at least 0.01, or only one of them known."""
    return F.coalesce(F.abs(new - old) >= 0.01, new.isNotNull() | old.isNotNull())


def card_changed(new, old) -> Column:
    """A list card differs from the stored one; ``new`` and ``old`` map names to columns."""
    title = F.trim(blank_safe(new("title")))
    status = blank_safe(new("source_status_raw"))
    return (
        _differs(new("price"), old("price"))
        | (F.coalesce(none_if_empty(new("currency")), F.lit("USD")) != F.coalesce(none_if_empty(old("currency")), F.lit("USD")))
        | ((title != "") & (title != F.trim(blank_safe(old("title")))))
        | _differs(new("area_sqm"), old("area_sqm"))
        | ((status != "") & ~F.coalesce(status == old("source_status_raw"), F.lit(False)))
    )


def fold_observations(
    obs: DataFrame, runs: DataFrame | None = None, grace_hours: int = 6, idle_hours: int | None = None,
    as_of: Column | None = None, hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Current listings of a log: the state after its last observation, one row per key.

    Sticky columns keep their last known value, the url and deal type are always the
    newest, all by aggregates. A listing that a later run missed (or that stayed idle until
    ``as_of``) is vanished.
    """
    position = F.struct(*ORDER)
    tracked = track_observations(obs, runs, grace_hours, idle_hours, hot_rows=hot_rows)
    same = [c for c in ("property_key", "deal_type", "district", "url") if c in obs.columns]
    folded = tracked.groupBy(*KEY).agg(
        *[F.max_by(F.col(c), position).alias(c) for c in same],
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), position)).alias(c) for c in STICKY],
        F.min("seen_at").alias("first_seen_at"),
        F.max("seen_at").alias("last_seen_at"),
        F.sum(F.col("price_dropped").cast("int")).cast("int").alias("price_drop_count"),
    )
    state = _missed(folded, "last_seen_at", runs, grace_hours, idle_hours, "_missed")
    mapped = map_status(F.col("source_status_raw"))
    gone = (mapped == "active") & F.col("_missed").isNotNull()
    if as_of is not None:
        gone = gone & (F.col("_missed") <= as_of)
    return state.withColumns({
        "status": F.when(gone, "vanished").otherwise(mapped),
        "vanished_at": F.when(gone, F.col("_missed")).when(mapped == "vanished", F.col("last_seen_at")),
        "updated_at": F.col("last_seen_at"),
    }).drop("_missed")


def needs_snapshot(tracked: DataFrame) -> DataFrame:
    """Observations that change what is known of a listing and so enter its history."""
    new, old = F.col, (lambda c: F.col(f"prev_{c}"))
    described = blank_safe(F.col("description"))
    gate = (
        F.col("prev_seen_at").isNull()
        | card_changed(new, old)
        | ((described != "") & (F.trim(described) != F.trim(blank_safe(F.col("prev_description")))))
        | ((blank_safe(F.col("phone")) != "") & F.col("prev_phone").isNull())
        | F.coalesce(F.col("stored_status") == "vanished", F.lit(False))
    )
    return tracked.where(gate)
