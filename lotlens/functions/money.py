"""Prices, rates per square metre and currencies as column rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotlens.config import DEFAULT, MarketConfig
from lotlens.functions.text import (
    NUMBER, any_contains, blank_safe, computed_once, extract, join_text, none_if_empty, number_value, parse_area,
    to_number,
)

INF = float("inf")

# --- Fixed values: currency marks next to a number, per-metre units (lower case) ----
MARKS = {
    "USD": (r"(?:usd|\$|дол(?:\.|арі|ларов)?)", r"(?:usd|\$|дол)", ("usd", "$", "дол")),
    "EUR": (r"(?:eur|€|євро)", r"(?:eur|€|євро)", ("eur", "€", "євро")),
    "UAH": (r"(?:uah|₴|грн)", r"(?:uah|₴|грн)", ("uah", "₴", "грн")),
}
PER_METRE = r"(?:\s*(?:(?:usd|\$|uah|₴|грн|eur|€)\s*)?/\s*(?:м²|м2|m2|sqm)|\s*за\s*м(?:²|2))"
RATE_NUMBER = r"(\d{1,3}(?:[ \u00a0]?\d{3}){0,3}(?:[.,]\d+)?|\d+(?:[.,]\d+)?)"
RATE_MARK = r"(usd|\$|uah|₴|грн|eur|€)?"
RATE_PATTERNS = (
    rf"{RATE_NUMBER}\s*{RATE_MARK}\s*/\s*м(?:²|2)(?![\p{{L}}\p{{N}}_])",
    rf"{RATE_NUMBER}\s*{RATE_MARK}\s*/\s*sqm(?![\p{{L}}\p{{N}}_])",
)
GLUED = 8
LOCAL_CURRENCY_PATTERN = r"грн|uah|₴"
PLAIN_NUMBER = r"(?<![\p{L}\p{N}_])((?:\d{1,3}(?:[ \u00a0]\d{3}){1,4}|\d{4,9}))(?:[.,]\d+)?(?![\p{L}\p{N}_])"


def is_rent(deal_type: Column) -> Column:
    return F.lower(blank_safe(deal_type)) == "rent"


def is_sale(deal_type: Column) -> Column:
    return F.lower(blank_safe(deal_type)) == "sale"


def clean_currency(currency: Column) -> Column:
    return F.upper(F.coalesce(none_if_empty(currency), F.lit("USD")))


def to_usd(amount: Column, currency: Column, cfg: MarketConfig = DEFAULT) -> Column:
    """Amount in USD, null for an unknown currency; names the amount once to keep plans small."""
    cur = clean_currency(currency)
    times = F.when(cur == "EUR", cfg.usd_per_eur).when(cur.isin("USD", "UAH"), 1.0)
    return amount * times / F.when(cur == "UAH", cfg.uah_per_usd).otherwise(1.0)


def usable(x: Column) -> Column:
    """A positive finite number (never null)."""
    return F.coalesce((x > 0) & (x < INF), F.lit(False))


def null_bad_price(price: Column, cfg: MarketConfig = DEFAULT) -> Column:
    return F.when(usable(price) & (price <= cfg.max_price), price)


def band(deal_type: Column, cfg: MarketConfig = DEFAULT) -> tuple[Column, Column]:
    low = F.when(is_sale(deal_type), cfg.sale_psm_min).when(is_rent(deal_type), cfg.rent_psm_min)
    high = F.when(is_sale(deal_type), cfg.sale_psm_max).when(is_rent(deal_type), cfg.rent_psm_max)
    return low, high


def in_band(rate_usd: Column, deal_type: Column, cfg: MarketConfig = DEFAULT) -> Column:
    low, high = band(deal_type, cfg)
    return rate_usd.between(low, high)


def suspicious_rate(rate_usd: Column, deal_type: Column, cfg: MarketConfig = DEFAULT) -> Column:
    """Rent above its ceiling; sale outside its band. Unknown rates are not suspicious."""
    finite = F.abs(rate_usd) < INF
    bad = F.when(is_rent(deal_type), rate_usd > cfg.rent_psm_max).when(
        is_sale(deal_type), (rate_usd < cfg.sale_psm_min) | (rate_usd > cfg.sale_psm_max)
    )
    return F.coalesce(finite & bad, F.lit(False))


def implied_rate(price: Column, area: Column) -> Column:
    return F.when(usable(price) & usable(area), F.round(price / area, 4))


def implied_rate_usd(price: Column, currency: Column, area: Column, cfg: MarketConfig = DEFAULT) -> Column:
    return to_usd(implied_rate(price, area), currency, cfg)


def fix_rent_currency(
    price: Column, currency: Column, area: Column, deal_type: Column,
    text: Column | None = None, cfg: MarketConfig = DEFAULT,
) -> Column:
    """Currency of a rent total: local when the text says so, or when only that is sane."""
    cur = clean_currency(currency)
    as_local = implied_rate_usd(price, F.lit("UAH"), area, cfg)
    too_dear = F.round(price / area, 4) > cfg.rent_psm_max
    says_local = F.lit(False) if text is None else F.lower(blank_safe(text)).rlike(LOCAL_CURRENCY_PATTERN)
    applies = is_rent(deal_type) & usable(price) & usable(area)
    sane_local = as_local.between(cfg.rent_psm_min, cfg.rent_psm_max)
    return (
        F.when(~applies, currency)
        .when(says_local | ((cur == "USD") & too_dear & sane_local), F.lit("UAH"))
        .otherwise(cur)
    )


def with_sane_rate(
    df: DataFrame, name: str = "price_per_sqm", rate: str = "price_per_sqm", currency: str = "currency",
    cfg: MarketConfig = DEFAULT,
) -> DataFrame:
    """The stored rate, or price/area when the stored one cannot be right.

    Reads ``price``, ``area_sqm`` and ``deal_type``. Steps are separate columns, so that
    each sub-expression is planned and computed once.
    """
    price, stored = F.col("price"), F.col(rate)
    implied, implied_usd, stored_usd = F.col("_s_imp"), F.col("_s_impu"), F.col("_s_stu")
    is_total = F.abs(stored - price) / F.greatest(price, F.lit(1.0)) < 0.02
    over_ceiling = is_rent(F.col("deal_type")) & (stored_usd > cfg.rent_psm_max) & (implied_usd <= cfg.rent_psm_max)
    far_off = F.abs(stored_usd - implied_usd) / F.greatest(implied_usd, F.lit(0.5)) > 0.35
    sane = (
        F.when(implied.isNull(), stored)
        .when(stored.isNull() | is_total, implied)
        .when(implied_usd.isNull(), stored)
        .when(over_ceiling | far_off, implied)
        .otherwise(stored)
    )
    return (
        df.withColumn("_s_imp", implied_rate(price, F.col("area_sqm")))
        .withColumns({
            "_s_impu": to_usd(implied, F.col(currency), cfg), "_s_stu": to_usd(stored, F.col(currency), cfg),
        })
        .withColumn(name, sane)
        .drop("_s_imp", "_s_impu", "_s_stu")
    )


def with_effective_rate(df: DataFrame, name: str = "rate_usd", cfg: MarketConfig = DEFAULT) -> DataFrame:
    """USD per square metre of a listing after currency repair and rate sanitising."""
    c = F.col
    rows = df.withColumn("_e_cur", fix_rent_currency(c("price"), c("currency"), c("area_sqm"), c("deal_type"), cfg=cfg))
    rows = with_sane_rate(rows, "_e_rate", "price_per_sqm", "_e_cur", cfg)
    rows = rows.withColumn("_e_usd", to_usd(c("_e_rate"), c("_e_cur"), cfg))
    return rows.withColumn(name, F.when(usable(c("_e_usd")), c("_e_usd"))).drop("_e_cur", "_e_rate", "_e_usd")


def with_rate(
    df: DataFrame, text: Column, value: str = "text_rate", currency: str = "text_rate_currency",
    cfg: MarketConfig = DEFAULT, lowered: bool = False,
) -> DataFrame:
    """First explicit "N per square metre" of a text and its currency (USD by default); ``lowered`` says that it is lower-case already."""
    metre, sqm = RATE_PATTERNS
    low, hit = F.col("_r_low"), F.col("_r_hit")
    found = F.coalesce(
        F.when(low.contains("/"), extract(low, metre, 0)), F.when(low.contains("sqm"), extract(low, sqm, 0)))
    number = F.regexp_extract(hit, RATE_NUMBER, 1)
    cur = (
        F.when(hit.contains("€") | hit.contains("eur"), "EUR")
        .when(hit.rlike(LOCAL_CURRENCY_PATTERN), "UAH").otherwise("USD")
    )
    return (
        df.withColumn("_r_low", text if lowered else F.lower(text)).withColumn("_r_hit", found)
        .withColumns({value: to_number(number, cfg.max_price), currency: F.when(hit.isNotNull(), cur)})
        .drop("_r_low", "_r_hit")
    )


def _candidate(alone: bool):
    def of(m: Column) -> Column:
        cur = F.when(any_contains(m, MARKS["USD"][2]), "USD").when(any_contains(m, MARKS["EUR"][2]), "EUR").otherwise("UAH")
        return F.struct(
            F.length(m).alias("len"), number_value(F.regexp_extract(m, NUMBER + r"(?!\d)", 0)).alias("value"),
            cur.alias("cur"), F.lit(alone).alias("alone"),
        )

    return of


def _candidates(low: Column, cfg: MarketConfig) -> Column:
    """Array of (len, value, cur, alone): numbers next to a currency mark that are not rates.

    A mark after a number closes it and opens no other, unless it stands apart from it and touches the
    next. ``alone`` is false where another number goes before, as the digits may then belong to
    both. ``low`` is lower-case text; a text without marks costs no regex. A match holds one mark, so all currencies share a
    scan; each pattern looks at the next character first.
    """
    empty = F.array().cast("array<struct<len:int,value:double,cur:string,alone:boolean>>")
    before, after = (f"(?:{'|'.join(marks[i] for marks in MARKS.values())})" for i in (0, 1))
    words = [w for marks in MARKS.values() for w in marks[2]]
    first = "[" + "".join(sorted({w[0] for w in words})) + "]"
    opened = rf"(?={first})(?:(?<!\d)(?<!\d\s{{1,3}}){before}\s*[:\s]*|(?<=\d\s{{1,3}}){before})"
    closed = rf"(?=({NUMBER}(?:(?={first}){after}|\s+(?={first}){after}(?!\d)))(?!{PER_METRE}))"
    patterns = (
        (rf"({opened}{NUMBER}(?!\d)(?![ \u00a0]\d{{3}}(?!\d)))(?!{PER_METRE})", True),
        (rf"(?=\d)(?<![\d.,])(?<!\d[ \u00a0]){closed}", True),
        (rf"(?=\d)(?<=\d[ \u00a0]){closed}", False),
    )
    found = F.concat(*[
        F.transform(F.regexp_extract_all(low, F.lit(p), F.lit(1)), _candidate(alone)) for p, alone in patterns])
    return F.filter(F.when(any_contains(low, words), found).otherwise(empty), lambda c: (c["value"] > 0) & (c["value"] <= cfg.max_price))


def with_total_price(
    df: DataFrame, text: Column, value: str = "text_total", currency: str = "text_currency",
    cfg: MarketConfig = DEFAULT,
) -> DataFrame:
    """Total price named in a text.

    Several numbers may qualify. A rate and an area in the same text settle it by the
    smallest relative error; a rate alone asks for at least 25 times the rate; otherwise
    USD goes first and the longest number wins (a shorter one is a tail of its digits). Where every
    number follows another one, glued digits are told by size: of readings of a
    thousand and more the smallest wins if the largest is over ``GLUED`` times as much.
    """
    low, cand, rate, rate_cur, area = (F.col(c) for c in ("_t_low", "_t_cand", "_t_rate", "_t_rcur", "_t_area"))
    staged = df.withColumn("_t_low", F.lower(text))
    staged = with_rate(staged, low, "_t_rate", "_t_rcur", cfg, lowered=True).withColumns({
        "_t_cand": _candidates(low, cfg), "_t_area": parse_area(low, lowered=True),
    })

    def error(c: Column) -> Column:
        off = F.abs(c["value"] / area - rate) / F.greatest(rate, F.lit(1.0))
        return F.when(c["cur"] == rate_cur, off).otherwise(999.0)

    def nearest(items: Column) -> Column:
        return F.array_min(F.transform(items, lambda c: F.struct(
            error(c).alias("err"), (-c["len"]).alias("len"), c["value"].alias("value"), c["cur"].alias("cur"))))

    def largest(items: Column) -> Column:
        return F.array_max(F.transform(items, lambda c: F.struct(
            c["value"].alias("value"), c["len"].alias("len"), c["cur"].alias("cur"))))

    def pick(c: Column) -> Column:
        return F.struct(c["value"].alias("value"), c["cur"].alias("cur"))

    def settled(items: Column, best) -> Column:
        alone = F.filter(items, lambda c: c["alone"])
        whole = F.filter(items, lambda c: c["value"] >= 1000)
        by_value = F.array_sort(F.transform(whole, lambda c: F.struct(c["value"].alias("value"), c["cur"].alias("cur"))))
        low_end, high_end = F.get(by_value, F.lit(0)), F.element_at(by_value, -1)
        return (
            F.when(F.size(alone) > 0, pick(best(alone))).when(F.size(whole) == 0, pick(best(items)))
            .when(high_end["value"] > GLUED * low_end["value"], low_end).otherwise(high_end)
        )

    staged = staged.withColumn("_t_usd", F.filter(cand, lambda c: c["cur"] == "USD")).withColumns({
        "_t_good": F.filter(F.col("_t_usd"), lambda c: c["value"] / rate >= 25),
        "_t_near": F.when(rate.isNotNull() & area.isNotNull() & (F.size(cand) > 1), nearest(cand)),
    })
    usd, plausible, near = F.col("_t_usd"), F.col("_t_good"), F.col("_t_near")
    bare_cur = (
        F.when(any_contains(low, MARKS["USD"][2]), "USD").when(any_contains(low, MARKS["EUR"][2]), "EUR")
        .when(any_contains(low, MARKS["UAH"][2]), "UAH")
    )
    bare = F.struct(
        F.when(bare_cur.isNotNull(), to_number(extract(low, PLAIN_NUMBER), cfg.max_price)).alias("value"),
        bare_cur.alias("cur"),
    )
    usd_rules = F.exists(cand, lambda c: c["cur"] == "UAH") | (F.size(usd) == F.size(cand))
    choice = (
        F.when(F.size(cand) == 0, bare)
        .when(F.size(cand) == 1, pick(F.element_at(cand, 1)))
        .when(near["err"] < 0.18, pick(near))
        .when((F.size(plausible) > 0) & near.isNotNull(), pick(nearest(plausible)))
        .when(F.size(plausible) > 0, pick(F.array_max(plausible)))
        .when((F.size(usd) > 0) & usd_rules, settled(usd, F.array_max))
        .otherwise(settled(cand, largest))
    )
    return (
        staged.withColumn("_t_pick", choice)
        .withColumns({value: F.col("_t_pick.value"), currency: F.col("_t_pick.cur")})
        .drop("_t_low", "_t_cand", "_t_rate", "_t_rcur", "_t_area", "_t_usd", "_t_good", "_t_near", "_t_pick")
    )


def normalize_price(
    df: DataFrame, name: str = "price_norm", cfg: MarketConfig = DEFAULT, once: bool = True,
) -> DataFrame:
    """Struct (price, currency, price_per_sqm, reinterpreted, suspicious, detail) per listing."""
    price, area, deal = F.col("price"), F.col("area_sqm"), F.col("deal_type")
    text = F.col("_n_text")
    staged = df.withColumn("_n_text", join_text(F.col("title"), F.col("description")))
    staged = with_rate(staged, text, "_n_rate", "_n_rcur", cfg)
    staged = with_total_price(staged, text, "_n_total", "_n_tcur", cfg)
    staged = staged.withColumns({
        "_n_cur": fix_rent_currency(price, clean_currency(F.col("currency")), area, deal, text, cfg),
        "_n_field": F.coalesce(F.when(F.col("price_per_sqm") != 0, F.col("price_per_sqm")), F.col("_n_rate")),
    })
    cur, rate, field, total = F.col("_n_cur"), F.col("_n_rate"), F.col("_n_field"), F.col("_n_total")
    # A text with total and rate: the option closest to rate * area.
    def off(t: Column) -> Column:
        return F.abs(t / area - rate) / F.greatest(rate, F.lit(1.0))

    options = F.filter(F.array(total, F.round(rate * area, 2), price), lambda t: t.isNotNull())
    closest = F.array_min(F.transform(options, lambda t, i: F.struct(off(t).alias("e"), i.alias("i"), t.alias("t"))))["t"]
    staged = with_sane_rate(staged, "_n_clean", "_n_field", "_n_cur", cfg).withColumns({
        "_n_agreed": F.when(off(price) < 0.06, price).otherwise(closest),
        "_n_stated": F.coalesce(F.col("_n_tcur"), cur),
        "_n_usd": to_usd(price, cur, cfg),
        "_n_rusd": to_usd(rate, cur, cfg),
    }).withColumn("_n_implied", F.col("_n_usd") / area).withColumns({
        "_n_odd": suspicious_rate(F.col("_n_implied"), deal, cfg),
        "_n_textodd": suspicious_rate(to_usd(F.col("_n_agreed"), F.col("_n_stated"), cfg) / area, deal, cfg),
        "_n_ratesane": F.col("_n_rusd").isNotNull() & ~suspicious_rate(F.col("_n_rusd"), deal, cfg),
        "_n_floor": F.when(is_rent(deal), cfg.rent_psm_min).otherwise(cfg.sale_psm_floor),
    })
    agreed, stated_cur, clean_rate = F.col("_n_agreed"), F.col("_n_stated"), F.col("_n_clean")
    usd, implied, floor = F.col("_n_usd"), F.col("_n_implied"), F.col("_n_floor")
    odd, rate_sane = F.col("_n_odd"), F.col("_n_ratesane")
    expanded = F.round(price * area, 2)
    expanded_rate = F.coalesce(field, price)
    as_rate_implausible = F.when(is_rent(deal), usd > cfg.rent_psm_max).otherwise(
        (usd < cfg.sale_psm_min) | (usd > cfg.sale_psm_max)
    )

    def out(p, c, r, re=False, sus=None, detail=None) -> Column:
        return F.struct(
            p.alias("price"), c.alias("currency"), r.alias("price_per_sqm"),
            F.lit(re).alias("reinterpreted"),
            (F.lit(False) if sus is None else sus).alias("suspicious"),
            (detail if isinstance(detail, Column) else F.lit(detail or "")).alias("detail"),
        )

    null = F.lit(None).cast("double")
    expl = F.coalesce(F.abs(rate - price) / F.greatest(price, F.lit(1.0)) < 0.05, F.lit(False))
    verdict = (
        F.when(
            total.isNotNull() & rate.isNotNull() & (area > 0),
            out(agreed, stated_cur, rate, sus=F.col("_n_textodd"), detail="text_total_and_psm"),
        )
        .when(
            (price.isNull() | area.isNull()) & rate.isNotNull() & field.isNull(),
            out(null, cur, rate, detail="explicit_psm_only"),
        )
        .when(~usable(price) | ~usable(area) | usd.isNull(), out(price, cur, field))
        .when((implied < floor) & expl, out(expanded, cur, expanded_rate, True, detail="explicit_psm_matches_price"))
        .when((implied < floor) & as_rate_implausible,
              out(price, cur, field, sus=F.lit(True), detail="skip_expand_implausible_rate"))
        .when(implied < floor, out(expanded, cur, expanded_rate, True, detail=F.concat(
            F.lit("implied_psm_usd="), F.format_string("%.4f", implied), F.lit("<"), floor.cast("string"))))
        .when(odd & rate_sane, out(F.round(rate * area, 2), cur, rate, detail="repair_absurd_from_text_psm"))
        .otherwise(out(price, cur, clean_rate, sus=odd))
    )
    rows = staged.withColumn(name, verdict)
    rows = rows.drop(*[c for c in rows.columns if c.startswith("_n_")])
    return computed_once(rows, name) if once else rows
