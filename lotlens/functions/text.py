"""Text rules as native column expressions (one vectorised function: Unicode folding)."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lotlens.config import DEFAULT
from lotlens.functions import rules

WORD = r"[\p{L}\p{N}_]"
NUMBER = r"(?:\d{1,3}(?:[ \u00a0]?\d{3}){1,3}|\d+(?:[.,]\d+)?)"


def none_if_empty(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def blank_safe(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def join_text(*cols: Column) -> Column:
    """Non-empty parts joined by one space; empty string when nothing is there."""
    return F.concat_ws(" ", *[none_if_empty(c) for c in cols])


def computed_once(df: DataFrame, *names: str) -> DataFrame:
    """Puts computed columns behind a generator of one row.

    A filter on a plain computed column is moved below it and repeats its whole rule chain;
    past a generator it reads the value.
    """
    rest = [c for c in df.columns if c not in names]
    boxed = df.select(*rest, F.explode(F.array(F.struct(*names))).alias("_once"))
    return boxed.select(*[F.col(f"_once.{c}").alias(c) if c in names else F.col(c) for c in df.columns])


def let(value: Column, body) -> Column:
    """``body`` applied to a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def any_contains(col: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [col.contains(w) for w in words])


def count_contains(col: Column, words) -> Column:
    return reduce(lambda a, b: a + b, [col.contains(w).cast("int") for w in words])


def extract(col: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group, null when there is none; the text is searched once."""
    return let(F.regexp_extract(col, pattern, group), none_if_empty)


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.str.normalize("NFKC")


def nfkc(col: Column) -> Column:
    """Compatibility folding; only rows with characters outside Latin-1/Cyrillic need it."""
    return _nfkc(col)


def normalize_text(col: Column) -> Column:
    """NFKC, lower, trim, backtick to apostrophe, runs of blanks to one; null -> ''."""
    text = F.trim(F.lower(nfkc(blank_safe(col))))
    return F.trim(F.regexp_replace(F.translate(text, "`", "'"), r"(?U)\s+", " "))


def normalize_address(col: Column) -> Column:
    text = F.regexp_replace(normalize_text(col), rules.ADDRESS_NOISE_PATTERN, " ")
    return F.trim(F.regexp_replace(text, rules.ADDRESS_NON_ALNUM, " "))


def phone_digits(col: Column) -> Column:
    """The last ten digits; null when fewer than nine digits are there."""
    return let(F.regexp_replace(col, r"\D+", ""), lambda digits: F.when(F.length(digits) >= 9, F.right(digits, F.lit(10))))


def number_value(col: Column) -> Column:
    """Double written with blanks, a decimal comma or dot groups (1.234.567)."""
    def ungrouped(plain: Column) -> Column:
        whole = F.regexp_replace(plain, r"(?<=^\d{1,3}(?:\.\d{3}){0,5})\.(?=(?:\d{3}\.)*\d{3}$)", "")
        return F.when(plain.contains("."), whole).otherwise(plain).try_cast("double")

    return let(F.translate(col, ", \u00a0", "."), ungrouped)  # blanks go, a comma becomes a dot


def to_number(col: Column, maximum: float | None = None) -> Column:
    """A positive finite number; anything that is not a plain number is null."""
    def positive(value: Column) -> Column:
        ok = (value > 0) & (value < float("inf"))
        return F.when(ok if maximum is None else ok & (value <= maximum), value)

    def parsed(raw: Column) -> Column:
        return F.when(F.translate(raw, " \u00a0", "").rlike(r"^[+-]?[\d.,]+(?:[eE][+-]?\d+)?$"), number_value(raw))

    return let(let(col, parsed), positive)


def parse_area(col: Column, lowered: bool = False) -> Column:
    """Area named in a text; ``lowered`` says that the text is lower-case already."""
    def named(low: Column) -> Column:
        raw = F.when(any_contains(low, ("м²", "м2", "кв")), extract(low, r"(\d+(?:[.,]\d+)?)\s*(?:м²|м2|кв\.?\s*м)"))
        return F.translate(raw, ",", ".").try_cast("double")

    return let(let(col if lowered else F.lower(col), named), lambda value: F.when((value > 0) & (value <= DEFAULT.max_area), value))


def parse_floor(col: Column) -> Column:
    def named(low: Column) -> Column:
        before = extract(low, r"(-?\d+)\s*(?:поверх|эт\.?|floor)")
        after = extract(low, r"(?:поверх|эт\.?|floor)\s*[:\-]?\s*(-?\d+)")
        return F.when(any_contains(low, ("поверх", "эт", "floor")), F.coalesce(before, after).try_cast("int"))

    return let(F.lower(col), named)


def with_area_floor(df: DataFrame, text: Column, area: str = "area_sqm", floor: str = "floor") -> DataFrame:
    return df.withColumns({area: parse_area(text), floor: parse_floor(text)})


def strip_price_junk(col: Column) -> Column:
    """Drop a leading photo counter with prices; keep the text when nothing would remain."""
    junk = (
        r"(?iu)^(?:\d+\s+){1,4}(?:\d{1,3}(?:[ \u00a0]\d{3})+\s*\$"
        r"(?:\s*\d{1,3}(?:[ \u00a0]\d{3})*\s*(?:USD|\$)?\s*/\s*м(?:²|2))?\s*)+"
    )
    cleaned = F.trim(F.regexp_replace(col, junk, ""))
    return F.coalesce(none_if_empty(cleaned), col)


def has_bc_word(text: Column) -> Column:
    return text.rlike(rf"(?<!{WORD})бц(?!{WORD})")


def guess_type(col: Column) -> Column:
    """Property type from words, first rule wins."""
    return let(F.lower(blank_safe(col)), _type_of)


def _type_of(t: Column) -> Column:
    has = lambda words: any_contains(t, words)
    return (
        F.when(has(rules.SHOWROOM_WORDS), "showroom")
        .when(has(rules.BUSINESS_CENTER_WORDS) | has_bc_word(t), "business_center")
        .when(has(rules.BUILDING_WORDS), "building")
        .when(has(rules.GUESS_OFFICE), "office")
        .when(has(rules.GUESS_WAREHOUSE), "warehouse")
        .when(has(rules.GUESS_RETAIL) & has(rules.GUESS_STREET), "street_retail")
        .when(has(rules.GUESS_RETAIL), "retail")
        .when(has(rules.GUESS_INDUSTRIAL), "industrial")
        .when(has(rules.GUESS_LAND), "land_commercial")
        .when(has(rules.GUESS_FREE), "free_purpose")
        .otherwise("other")
    )


def in_region(url: Column) -> Column:
    return let(F.lower(blank_safe(url)), lambda low: ~any_contains(low, rules.REGION_FOREIGN) & any_contains(low, rules.REGION_LOCAL))


def normalize_district(col: Column, districts=rules.DISTRICTS, stems=rules.DISTRICT_STEMS) -> Column:
    """Canonical district: by containment of the name, then by an alias stem."""
    low = F.trim(F.replace(F.replace(F.lower(F.trim(col)), F.lit(" район"), F.lit("")), F.lit(" р-н"), F.lit("")))

    def named(t: Column) -> Column:
        out = None
        for name, _ in districts:
            key = name.lower()
            hit = t.contains(key) | ((F.length(t) >= 4) & F.lit(key).contains(t))
            out = F.when(hit, name) if out is None else out.when(hit, name)
        for stem, name in stems:
            out = out.when(t.contains(stem), name)
        return out

    return let(low, named)


def extract_district(*cols: Column) -> Column:
    """District named in free text: an adjective form first, else the whole text."""
    blob = none_if_empty(join_text(*cols))
    return let(blob, lambda t: normalize_district(F.coalesce(extract(t, rules.DISTRICT_MENTION), t)))


def listing_district() -> Column:
    """District of a listing row: its own field, else named in address, title or city."""
    return F.coalesce(
        normalize_district(F.col("district")),
        extract_district(F.col("address_raw"), F.col("title"), F.col("city")),
    )


def with_district(df: DataFrame, name: str = "district_norm") -> DataFrame:
    return df.withColumn(name, listing_district())


def extract_phones(col: Column) -> Column:
    """Ordered distinct local phone numbers of a text."""
    found = F.concat(*[F.regexp_extract_all(col, F.lit(p), F.lit(1)) for p in rules.PHONE_PATTERNS])
    digits = F.transform(found, phone_digits)
    valid = F.filter(
        digits,
        lambda d: (F.length(d) == 10) & F.substring(d, 1, 3).isin(*rules.PHONE_PREFIXES),
    )
    return F.array_distinct(valid)


def map_status(col: Column) -> Column:
    """Portal status text -> listing status; anything else is active."""
    low = F.lower(blank_safe(col))
    out = None
    for status, words in rules.STATUS_WORDS:
        hit = any_contains(low, words)
        out = F.when(hit, status) if out is None else out.when(hit, status)
    return out.otherwise("active")


def cap_rate(col: Column) -> Column:
    value = F.translate(extract(col, rules.CAP_RATE_PATTERN), ",", ".").try_cast("double")
    return F.when((value > 0) & (value < 100), value)


def net_operating_income(col: Column) -> Column:
    return to_number(extract(col, rules.NOI_PATTERN))


def with_finance_terms(df: DataFrame, text: Column) -> DataFrame:
    return df.withColumns({"cap_rate_pct": cap_rate(text), "noi": net_operating_income(text)})


def detect_opex(*cols: Column) -> Column:
    """with / without / unknown from explicit words; conflicting words are unknown."""
    blob = join_text(*cols)
    without, with_ = blob.rlike(rules.OPEX_WITHOUT_PATTERN), blob.rlike(rules.OPEX_WITH_PATTERN)
    return F.when(without & ~with_, "without").when(with_ & ~without, "with").otherwise("unknown")


def resolve_opex(stored: Column, *text: Column) -> Column:
    """A stored with/without wins; otherwise the text decides."""
    return F.when(stored.isin("with", "without"), stored).otherwise(detect_opex(*text))


def classify_seller(
    agency: Column, phone: Column, title: Column, description: Column, phone_listings: Column,
    agency_phone_min: int = DEFAULT.agency_phone_min,
) -> Column:
    looks_agency = join_text(agency, title, description).rlike(rules.AGENCY_PATTERN)
    return (
        F.when(F.trim(blank_safe(agency)) != "", "agency")
        .when(looks_agency, "agency")
        .when(phone_listings >= agency_phone_min, "agency")
        .when((blank_safe(phone) != "") & (phone_listings == 1), "owner")
        .otherwise("unknown")
    )


def street_address(col: Column, max_name: int) -> Column:
    return F.trim(extract(col, rules.STREET_PATTERN % max_name))


def listing_id_from_url(url: Column) -> Column:
    """Marked alphanumeric id, else a long number closing the path, else a path number."""
    path = F.regexp_extract(url, r"^[^?]*", 0)
    return F.coalesce(
        extract(path, r"-ID([A-Za-z0-9]+)\.html"),
        extract(path, r"(\d{6,})(?:\.html)?$"),
        extract(path, r"/(\d{6,})"),
    )


def keyword_rule(col: Column, table, default=None) -> Column:
    """First matching (words, value) row of a rule table."""
    out = None
    for words, value in table:
        hit = any_contains(col, words)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(default)
