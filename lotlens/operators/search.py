"""Catalog search: predicates, lookups, annotation, sorting, paging and saved filters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotlens.config import DEFAULT, SORT_MODES, MarketConfig
from lotlens.functions import rules
from lotlens.functions.money import to_usd, usable, with_effective_rate
from lotlens.functions.text import classify_seller, let, phone_digits
from lotlens.operators.changes import KEY
from lotlens.operators.market import is_active, with_market_hint
from lotlens.operators.relational import BROADCAST_ROWS, checked_broadcast, lookup_join, top_n_per_group
from lotlens.session import passing, scratch, spread, stored


def list_listings(
    df: DataFrame, status: str | None = None, source: str | None = None, deal_type: str | None = None,
    limit: int = 50, offset: int = 0,
) -> DataFrame:
    for name, value in (("status", status), ("source", source), ("deal_type", deal_type)):
        if value:
            df = df.where(F.col(name) == value)
    return df.orderBy(F.col("last_seen_at").desc(), *KEY).offset(offset).limit(limit)


def list_properties(
    df: DataFrame, active: bool | None = None, deal_type: str | None = None, limit: int = 50, offset: int = 0,
) -> DataFrame:
    if active is not None:
        df = df.where(F.col("is_active") == active)
    if deal_type:
        df = df.where(F.col("deal_type") == deal_type)
    return df.orderBy(F.col("last_seen_at").desc(), "fingerprint").offset(offset).limit(limit)


def catalog_base(df: DataFrame, deal_type: str, activity: str | None = None) -> DataFrame:
    """Base rows of the catalog, by activity mode (None, vanished, price_drop)."""
    df = df.where(F.col("deal_type") == deal_type)
    if activity == "vanished":
        return df
    if activity == "price_drop":
        return df.where(F.col("status").isin("active", "relisted", "vanished"))
    return df.where(is_active() & F.col("price").isNotNull())


def has_text(q: str | Column) -> Column:
    """Case-insensitive containment in title, address, district or city."""
    needle = F.lower(F.trim(q if isinstance(q, Column) else F.lit(q)))
    hits = [F.coalesce(F.lower(c).contains(needle), F.lit(False)) for c in TEXT_FIELDS]
    return hits[0] | hits[1] | hits[2] | hits[3]


def text_search(df: DataFrame, q: str) -> DataFrame:
    return df.where(has_text(q))


def district_filter(df: DataFrame, district: str, labels=rules.DISTRICTS) -> DataFrame:
    """Rows whose district text holds the name or its label in the other language."""
    low = F.lower("district")
    names = [district, *[label for name, label in labels if name == district]]
    cond = F.col("district") == district
    for name in names:
        cond = cond | low.contains(name.lower())
    return df.where(cond)


def period_filter(df: DataFrame, period: str | None, as_of: Column) -> DataFrame:
    hours = {"24h": 24, "7d": 168}.get(period)
    return df if hours is None else df.where(F.col("first_seen_at") >= as_of - F.expr(f"INTERVAL {hours} HOURS"))


def with_usd(df: DataFrame, name: str = "price_usd", cfg: MarketConfig = DEFAULT) -> DataFrame:
    return df.withColumn(name, to_usd(F.col("price"), F.col("currency"), cfg))


def range_filter(
    df: DataFrame, price_min: float | None = None, price_max: float | None = None,
    area_min: float | None = None, area_max: float | None = None, cfg: MarketConfig = DEFAULT,
) -> DataFrame:
    """Price range in USD and area range; reversed bounds are swapped, missing values fail."""
    if None not in (price_min, price_max) and price_min > price_max:
        price_min, price_max = price_max, price_min
    if None not in (area_min, area_max) and area_min > area_max:
        area_min, area_max = area_max, area_min
    usd = to_usd(F.col("price"), F.col("currency"), cfg)
    for value, low, high in ((usd, price_min, price_max), (F.col("area_sqm"), area_min, area_max)):
        if low is not None:
            df = df.where(value >= low)
        if high is not None:
            df = df.where(value <= high)
    return df


def semi(df: DataFrame, ids: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(ids.select(*keys).distinct(), list(keys), "left_semi")


def days_on_market(first_seen: Column, as_of: Column) -> Column:
    seconds = F.unix_timestamp(as_of) - F.unix_timestamp(first_seen)
    return F.greatest(F.lit(0), F.floor(seconds / 86_400)).cast("int")


def with_sort_key(df: DataFrame, mode: str, as_of: Column, cfg: MarketConfig = DEFAULT) -> tuple[DataFrame, list[Column]]:
    """Listings with the ``_sort`` column of a mode and the order over it: nulls last, ties by key."""
    if mode not in SORT_MODES:
        mode = "newest"
    if mode in ("newest", "oldest"):
        rows, way = df.withColumn("_sort", F.col("first_seen_at")), "desc" if mode == "newest" else "asc"
    else:
        what, way = mode.rsplit("_", 1)
        if what == "psm":
            rows = with_effective_rate(df, "_sort", cfg)
        else:
            value = {
                "price": to_usd(F.col("price"), F.col("currency"), cfg), "area": F.col("area_sqm"),
                "dom": days_on_market(F.col("first_seen_at"), as_of),
            }[what]
            rows = df.withColumn("_sort", value)
    key = F.col("_sort")
    return rows, [key.asc_nulls_last() if way == "asc" else key.desc_nulls_last(), *[F.col(k) for k in KEY]]


def sort_listings(df: DataFrame, mode: str, as_of: Column, cfg: MarketConfig = DEFAULT) -> DataFrame:
    rows, order = with_sort_key(df, mode, as_of, cfg)
    return rows.orderBy(*order).drop("_sort")


def first_pages(
    df: DataFrame, modes: Sequence[str], as_of: Column, n: int = 50, cfg: MarketConfig = DEFAULT, accuracy: int = 10_000,
) -> DataFrame:
    """The first ``n`` listings of every sort mode, with ``mode`` and ``rank``; two scans for any number of modes.

    The first scan sketches the sort keys of all modes; of each it takes the smallest quantile that surely holds ``n`` rows.
    The second keeps rows up to that cut in some mode, so that the exact ranking (nulls last, ties by key) sees a sliver of the rows. The
    sketches' quantiles, six numbers per sort value, come to the driver. A mode with too few rows for a cut keeps all of them.
    """
    ways = {m: ("seen", m == "oldest") if m in ("newest", "oldest") else (m.rsplit("_", 1)[0], m.endswith("asc")) for m in modes}
    values = {what: m for m, (what, _) in ways.items()}
    rows = df
    for what, mode in values.items():
        keyed, _ = with_sort_key(rows, mode, as_of, cfg)
        # microseconds of any date before the year 2255 are whole doubles
        value = F.unix_micros("_sort") if what == "seen" else F.col("_sort")
        rows = keyed.withColumn(f"_by_{what}", value.cast("double")).drop("_sort")
    shares = [2 / accuracy, 0.01, 0.1]
    asked = F.array(*map(F.lit, [*shares, *[1 - x for x in shares]]))
    told = rows.agg(*[x for v in values for x in (F.count(f"_by_{v}").alias(f"n_{v}"), F.percentile_approx(f"_by_{v}", asked, accuracy).alias(f"at_{v}"))]).first()

    def wanted(what: str, up: bool) -> Column:
        cuts = told[f"at_{what}"] or [0.0] * 6
        for share, low, high in zip(shares, cuts[:3], cuts[3:]):
            if told[f"n_{what}"] * (share - 1 / accuracy) >= n:
                return F.col(f"_by_{what}") <= low if up else F.col(f"_by_{what}") >= high
        return F.lit(True)

    found = F.filter(F.array(*[
        F.when(wanted(what, up), F.struct(F.lit(m).alias("mode"), (F.col(f"_by_{what}") * (1 if up else -1)).alias("_key"))) for m, (what, up) in ways.items()
    ]), lambda x: x.isNotNull())
    close = rows.withColumn("_at", F.explode(found)).select(*df.columns, "_at.mode", "_at._key")
    # a window that keeps few rows is limited in every task before the shuffle
    first = Window.partitionBy("mode").orderBy(F.col("_key").asc_nulls_last(), *[F.col(k) for k in KEY])
    return close.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= n).drop("_key")


def facets(df: DataFrame, deal_type: str) -> DataFrame:
    """Segments and sources of a deal type by falling count."""
    rows = df.where(F.col("deal_type") == deal_type)
    pair = F.explode(F.create_map(F.lit("segment"), F.col("property_type"), F.lit("source"), F.col("source")))
    return (
        rows.select(pair.alias("facet", "value")).where(F.col("value").isNotNull())
        .groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n")).orderBy("facet", F.col("n").desc(), "value")
    )


# --- lookups --------------------------------------------------------------------------------


def phone_frequency(listings: DataFrame) -> DataFrame:
    """Listings per normalised phone."""
    return (
        listings.select(phone_digits(F.col("phone")).alias("phone_digits")).where(F.col("phone_digits").isNotNull())
        .groupBy("phone_digits").agg(F.count(F.lit(1)).alias("phone_listings"))
    )


def with_phone_count(listings: DataFrame, everyone: DataFrame | None = None) -> DataFrame:
    """Adds how many listings (of ``everyone``) carry the phone; 1 when unknown."""
    counts = phone_frequency(listings if everyone is None else everyone)
    keyed = listings.withColumn("phone_digits", phone_digits(F.col("phone")))
    found = lookup_join(keyed, counts.withColumn("_n", F.col("phone_listings")), ["phone_digits"], "_n").drop("_n")
    return found.withColumn("phone_listings", F.coalesce("phone_listings", F.lit(1)))


def portal_counts(listings: DataFrame) -> DataFrame:
    """Listings per premises."""
    return listings.where(F.col("property_key").isNotNull()).groupBy("property_key").agg(F.count(F.lit(1)).alias("portals"))


def portal_spreads(listings: DataFrame, cfg: MarketConfig = DEFAULT) -> DataFrame:
    """Price spread of premises with two or more active priced listings.

    The set of sources is bounded by the number of portals, so it stays small.
    """
    usd = to_usd(F.col("price"), F.col("currency"), cfg)
    good = F.when(usable(usd), usd)
    rows = listings.where(is_active() & F.col("price").isNotNull() & F.col("property_key").isNotNull())
    grouped = rows.groupBy("property_key").agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("source")).alias("sources"),
        F.count(good).alias("_good"), F.min(good).alias("_low"), F.max(good).alias("_high"),
    ).where(F.col("n") >= 2)
    two = F.col("_good") >= 2
    return grouped.select(
        "property_key", "n", "sources", F.when(two, F.round("_low", 0)).alias("price_min_usd"),
        F.when(two, F.round("_high", 0)).alias("price_max_usd"),
        F.when(two, F.round((F.col("_high") - F.col("_low")) / F.col("_low") * 100, 1)).alias("spread_pct"),
    )


def with_portals(listings: DataFrame, everyone: DataFrame | None = None, cfg: MarketConfig = DEFAULT) -> DataFrame:
    """Adds the portal count, the sources and the price spread of the premises."""
    base = listings if everyone is None else everyone
    side = portal_counts(base).join(portal_spreads(base, cfg).select("property_key", "sources", "spread_pct"), "property_key", "left")
    found = lookup_join(
        listings, side.withColumnsRenamed({"sources": "portal_sources", "spread_pct": "portal_spread_pct"}),
        ["property_key"], "portals")
    return found.withColumn("portals", F.coalesce("portals", F.lit(1)))


def with_seller(listings: DataFrame, everyone: DataFrame | None = None, cfg: MarketConfig = DEFAULT) -> DataFrame:
    c = F.col
    return with_phone_count(listings, everyone).withColumn("seller", classify_seller(
        c("agency"), c("phone"), c("title"), c("description"), c("phone_listings"), cfg.agency_phone_min))


def annotate(
    listings: DataFrame, market: DataFrame, as_of: Column, everyone: DataFrame | None = None, cfg: MarketConfig = DEFAULT
) -> DataFrame:
    """Everything the catalog shows beside a listing: market hint, seller, portals, cap rate, NOI, flags, days on market.

    ``listings`` comes from `prepare_market`; ``everyone`` is the whole listing table when
    ``listings`` is only a part of it.
    """
    base = listings if everyone is None else everyone
    rows = with_market_hint(listings, market, cfg)
    rows = with_seller(rows, base, cfg)
    rows = with_portals(rows, base, cfg)
    extra = (lambda c: F.col(f"raw_extra.{c}")) if "raw_extra" in rows.columns else (lambda c: F.lit(None))
    return rows.withColumns({
        "cap_rate_pct": extra("cap_rate_pct").cast("double"), "noi": extra("noi").cast("double"),
        "price_suspicious": F.coalesce(extra("price_suspicious").cast("boolean"), F.lit(False)),
        "excluded_from_stats": F.coalesce("exclude_from_stats", F.lit(False)),
        "dom_days": days_on_market(F.col("first_seen_at"), as_of),
    })


# --- saved filters ------------------------------------------------------------------------------


#: Lengths of the runs of characters that index texts; a searched text uses the longest that it holds.
GRAMS = (3, 6, 12, 24)
SHORT_TEXT = 200
#: Rows up to which a table of 64-bit keys is broadcast, some 80 bytes of memory each.
HASH_ROWS = 4_000_000
#: Listings and filters of a cell of a key whose pairs are more than their product; and the tasks such cells get at most.
CELL = (50_000, 10_000)
MOST_TASKS = 4_000
TEXT_FIELDS = ("title", "address_raw", "district", "city")


def _grams(text: Column, size: int) -> Column:
    """All runs of ``size`` (of ``GRAMS``) characters, null for shorter texts; beyond ``SHORT_TEXT`` characters in time linear in the text."""
    cut = F.transform(F.sequence(F.lit(1), F.length(text) - (size - 1)), lambda i: F.substring(text, i, F.lit(size)))
    return F.when(F.length(text) >= size, F.when(F.length(text) <= SHORT_TEXT, cut).otherwise(_long_grams(text, size)))


def _long_grams(text: Column, size: int) -> Column:
    if size == GRAMS[0]:
        chars = F.split(text, "")
        pairs = F.zip_with(chars, F.slice(chars, F.lit(2), F.length(text)), lambda a, b: F.concat(a, b))
        runs = F.zip_with(pairs, F.slice(chars, F.lit(3), F.length(text)), lambda a, b: F.concat(a, b))
        return F.filter(runs, lambda r: r.isNotNull())
    half = size // 2

    def doubled(runs: Column) -> Column:
        pairs = F.zip_with(runs, F.slice(runs, F.lit(half + 1), F.length(text)), lambda a, b: F.concat(a, b))
        return F.filter(pairs, lambda r: r.isNotNull())

    return let(_long_grams(text, half), doubled)


def _gram_size(needle: Column) -> Column:
    """The longest of ``GRAMS`` that a text holds."""
    size = F.when(F.length(needle) >= GRAMS[0], GRAMS[0])
    for n in GRAMS[1:]:
        size = F.when(F.length(needle) >= n, n).otherwise(size)
    return size


def _text_hashes(sizes: Sequence[int]) -> Column:
    """Hashes of the distinct runs of these sizes in the fields that ``has_text`` searches."""
    none = F.array().cast("array<bigint>")

    def runs(text: Column) -> Column:
        return F.concat(none, *[F.coalesce(F.transform(_grams(text, n), lambda run: F.xxhash64(run)), none) for n in sizes])

    # bound first, or every run would lower its whole text again
    return F.array_distinct(F.concat(*[let(F.lower(c), runs) for c in TEXT_FIELDS]))


def _few(df: DataFrame, most: int) -> bool:
    return df.limit(most + 1).count() <= most


def text_anchors(needles: DataFrame, listings: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """(needle, anchor, n): of the longest runs of a searched text the one that fewest listings hold, ``n`` of them; ``sizes`` are those of all needles.

    Runs are counted by their hash: two that share one are counted together, which can only change the choice.
    """
    needle, none = F.col("needle"), F.array().cast("array<string>")
    own = F.concat(none, *[F.when(_gram_size(needle) == n, _grams(needle, n)).otherwise(none) for n in sizes])
    asked = needles.select("needle").distinct().select("needle", F.explode(F.array_distinct(own)).alias("gram"))
    asked = stored(asked.withColumn("_hash", F.xxhash64("gram")), "grams")
    held, wanted = listings.select(F.explode(_text_hashes(sizes)).alias("_hash")), asked.select("_hash").distinct()
    if _few(wanted, HASH_ROWS):  # else every task sums its runs before the shuffle
        held = held.join(F.broadcast(wanted), "_hash")
    counted = held.groupBy("_hash").agg(F.count(F.lit(1)).alias("n"))
    rated = asked.join(counted, "_hash", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rated.groupBy("needle").agg(F.min_by("gram", F.struct("n", "gram")).alias("anchor"), F.min("n").alias("n"))


def _in_cells(rows: DataFrame, side: DataFrame, cell: tuple[int, int]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of the join of listings (``_lkey``) and filters (``_wkey``, ``_n`` listings at most) with the columns it is over.

    A key of many pairs is cut into cells of some ``cell`` listings and filters: each listing goes to all pieces of its key's filters, each filter
    to all pieces of its listings, so tasks grow with the pairs and not with one key. A listing whose key no filter has goes no further.
    """
    per_key = side.groupBy("_wkey").agg(F.count(F.lit(1)).alias("_m"), F.max("_n").alias("_n"))
    pieces = lambda count, size: F.ceil(F.col(count) / size).cast("int")
    hot = stored(per_key.where(F.col("_m") * F.col("_n") > cell[0] * cell[1]).select(
        F.col("_wkey").alias("_hkey"), pieces("_n", cell[0]).alias("_ls"), pieces("_m", cell[1]).alias("_ws")), "hot-filters")
    cells = hot.agg(F.sum(F.col("_ls") * F.col("_ws"))).first()[0] or 0
    keys = per_key.select(F.xxhash64("_wkey").alias("_khash")).distinct()
    if _few(keys, HASH_ROWS):
        rows = rows.join(F.broadcast(keys), F.xxhash64("_lkey") == F.col("_khash")).drop("_khash")

    def dealt(df: DataFrame, key: str, own: str, others: str, at: str, copied: str) -> DataFrame:
        found = df.join(checked_broadcast(hot), F.col(key) == F.col("_hkey"), "left").withColumn(
            at, F.when(F.col(own) > 1, F.pmod(F.xxhash64(*df.columns), F.col(own))).otherwise(0).cast("int"))
        copies = F.when(F.col(others) > 1, F.sequence(F.lit(0), F.col(others) - 1)).otherwise(F.array(F.lit(0)))
        return found.withColumn(copied, F.explode(copies)).drop("_hkey", "_ls", "_ws")

    rows = dealt(rows, "_lkey", "_ls", "_ws", "_lcell", "_wcell")
    side = dealt(side, "_wkey", "_ws", "_ls", "_w_wcell", "_w_lcell")
    if cells:
        wanted = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(2 * cells, MOST_TASKS))
        rows, side = rows.repartition(wanted, "_lkey", "_lcell", "_wcell"), side.repartition(wanted, "_wkey", "_w_lcell", "_w_wcell")
    return rows, side, ["_lcell", "_wcell"]


def match_watches(
    watches: DataFrame, listings: DataFrame, as_of: Column, cfg: MarketConfig = DEFAULT, index_from: int = 1_000,
    broadcast_rows: int = BROADCAST_ROWS, cell: tuple[int, int] = CELL,
) -> DataFrame:
    """(watch name, listing key) for every saved filter a catalog listing meets.

    Optional equality fields form a composite key with ``*`` for "any"; a listing looks up
    the few field combinations that filters really use, so this is an equi-join with the
    ranges, period and text as residual conditions. From ``index_from`` searched texts on (of three characters
    or more), the key of a filter with a text also holds the text. A listing finds the texts by the runs they have in common: each text by the rarest
    of its runs of 24, 12, 6 or 3 characters, whichever is the longest it has, and holds the two against each other once, however many filters share the text.
    ``listings`` carries ``below_market``. Beyond ``broadcast_rows`` filters the join is a shuffle of the listings that have some filter's key, in cells (`_in_cells`).
    """
    fields = {"source": "source", "deal_type": "deal_type", "segment": "property_type", "district": "district"}
    blank = lambda c: F.when((c == "") | c.isNull(), F.lit("*")).otherwise(c)
    mask = F.concat(*[F.when((F.col(f) == "") | F.col(f).isNull(), F.lit("0")).otherwise(F.lit("1")) for f in fields])
    needle = F.lower(F.trim("q"))
    keyed = watches.select(
        "name", F.concat_ws("|", *[blank(F.col(f)) for f in fields]).alias("_wkey"), mask.alias("_mask"),
        "q", "period", "below_market", "price_min", "price_max", F.when(F.length(needle) >= 3, needle).alias("needle"),
    )
    needles = keyed.where(F.col("needle").isNotNull()).select("needle").distinct()
    indexed = needles.limit(index_from).count() >= max(index_from, 1)
    used = [*dict.fromkeys([*KEY, *fields.values(), *TEXT_FIELDS, "price", "currency", "first_seen_at", "below_market"])]
    listings = listings.select(*used)
    if indexed:
        spark = watches.sparkSession
        at = {name: scratch(spark, name) for name in ("filtered", "anchors", "watches")}
        with passing(spark):
            listings = stored(spread(listings), "filtered", at["filtered"])
            sizes = sorted(r[0] for r in needles.select(_gram_size(F.col("needle"))).distinct().collect())  # of ``GRAMS``
            anchors = stored(text_anchors(needles, listings, sizes).withColumn("_hash", F.xxhash64("anchor")), "anchors", at["anchors"])
            keyed = stored(keyed.join(checked_broadcast(anchors.select("needle", "n")), "needle", "left"), "watches", at["watches"])
    else:
        keyed = keyed.withColumn("n", F.lit(None).cast("bigint"))
    texted = F.lit(indexed) & F.col("needle").isNotNull()
    keyed = keyed.withColumns({"_texted": texted, "_wkey": F.concat_ws("|", "_wkey", F.when(texted, F.col("needle")).otherwise("")), "lowered": needle})
    masks = [tuple(r) for r in keyed.select("_mask", "_texted").distinct().collect()]  # at most 32 combinations
    lows = [f"_low_{c}" for c in TEXT_FIELDS]
    rows = with_usd(listings, "_usd", cfg).withColumns({low: F.lower(c) for low, c in zip(lows, TEXT_FIELDS)})

    def held(text: Column) -> Column:
        """As `has_text`, with the lower-case texts of a listing computed once."""
        return reduce(or_, [F.coalesce(F.col(c).contains(text), F.lit(False)) for c in lows])

    def looked_up(rows: DataFrame, text: Column, of_texted: bool) -> DataFrame:
        """Listings by the keys they look up."""
        found = [
            F.concat_ws("|", *[
                F.coalesce(F.col(col), F.lit("~")) if bit == "1" else F.lit("*") for bit, col in zip(m, fields.values())
            ], text) for m, t in sorted(masks) if t == of_texted
        ]
        return rows.withColumn("_lkey", F.explode(F.array(*found) if found else F.array().cast("array<string>"))).select(
            *KEY, "_lkey", "_usd", "first_seen_at", F.col("below_market").alias("_below"), *[F.lit(None).cast("string").alias(c) if of_texted else F.col(c) for c in lows])

    found = []
    if not masks or not all(t for _, t in masks):
        found.append(looked_up(rows, F.lit(""), False))
    if any(t for _, t in masks):
        runs = rows.withColumn("_hash", F.explode(_text_hashes(sizes)))
        if not _few(anchors, BROADCAST_ROWS):
            runs = runs.join(checked_broadcast(anchors.select("_hash").distinct(), HASH_ROWS), "_hash", "left_semi")
        texts = checked_broadcast(anchors.select("_hash", "needle"))
        found.append(looked_up(runs.join(texts, "_hash").where(held(F.col("needle"))), F.col("needle"), True))
    rows = reduce(DataFrame.unionByName, found)
    low, high = F.least("price_min", "price_max"), F.greatest("price_min", "price_max")
    both = F.col("price_min").isNotNull() & F.col("price_max").isNotNull()
    side = keyed.select(
        "name", "_wkey", "_texted", "lowered", F.when(F.col("q") != "", True).alias("_asks"), F.when(F.col("period") == "24h", 24).when(F.col("period") == "7d", 168).alias("_hours"),
        F.coalesce("below_market", F.lit(False)).alias("_cheap"), F.when(both, low).otherwise(F.col("price_min")).alias("_from"),
        F.when(both, high).otherwise(F.col("price_max")).alias("_to"), F.col("n").alias("_n"))
    same_cell = []
    if _few(side, broadcast_rows):
        side = F.broadcast(side)
    else:
        side = side.withColumn("_n", F.coalesce("_n", F.lit(listings.count())))
        rows, side, same_cell = _in_cells(rows, side, cell)
    age = F.unix_timestamp(as_of) - F.unix_timestamp("first_seen_at")
    cond = (
        reduce(and_, [F.col(c) == F.col(f"_w{c}") for c in same_cell], F.col("_lkey") == F.col("_wkey"))
        & (F.col("_hours").isNull() | (age <= F.col("_hours") * 3600))
        & (~F.col("_cheap") | F.col("_below"))
        & (F.col("_from").isNull() | (F.col("_usd") >= F.col("_from")))
        & (F.col("_to").isNull() | (F.col("_usd") <= F.col("_to")))
    )
    if len(found) > 1 or not any(t for _, t in masks):
        cond = cond & (F.col("_texted") | F.col("_asks").isNull() | held(F.col("lowered")))
    return rows.join(side, cond).select("name", *KEY)


# --- detail -------------------------------------------------------------------------------------


def property_detail(
    listings: DataFrame, events: DataFrame, hypotheses: DataFrame, last_events: int | None = None
) -> DataFrame:
    """Detail rows per premises: its listings, its events (the newest ``last_events``, or all) and its hypotheses.

    One long table ``(property_key, section, position, source, external_id, label, at)``:
    sections of any size stay spread over tasks.
    """
    def section(df: DataFrame, name: str, label: Column, at: str) -> DataFrame:
        return df.where(F.col("property_key").isNotNull()).select(
            "property_key", F.lit(name).alias("section"), *KEY, label.cast("string").alias("label"), F.col(at).alias("at"))

    told = section(events, "event", F.col("event_type"), "occurred_at")
    newest = told if last_events is None else top_n_per_group(
        told, ["property_key"],
        [F.col("at").desc(), "label", *KEY], last_events, F.concat_ws("|", "source", "external_id", "label", F.col("at").cast("string")),
    ).drop("rank")
    return section(listings, "listing", F.col("status"), "last_seen_at").unionByName(newest).unionByName(
        section(hypotheses, "hypothesis", F.col("bucket"), "created_at"))
