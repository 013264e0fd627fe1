"""Segment classifier: one ordered rule chain per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotlens.functions import rules
from lotlens.functions.text import WORD, any_contains, blank_safe, computed_once, has_bc_word, join_text


def _verdict(relevant: bool, segment, reason: str) -> Column:
    segment = segment if isinstance(segment, Column) else F.lit(segment)
    return F.struct(
        F.lit(relevant).alias("relevant"), segment.alias("segment"), F.lit(reason).alias("reason")
    )


def segment_decision(
    text: Column, url: Column, title: Column, property_type: Column, floor: Column
) -> Column:
    """Struct (relevant, segment, reason); text and url are expected in lower case."""
    has = lambda words: any_contains(text, words)
    whole = "|".join(rules.EXCLUDE_WHOLE_WORDS)
    excluded = has(rules.EXCLUDE_WORDS) | text.rlike(rf"(?<!{WORD})(?:{whole})(?!{WORD})")
    first_floor = F.coalesce(floor == 1, F.lit(False))
    no_showroom_words = ~has(("шоурум", "showroom"))
    retail = has(rules.RETAIL_WORDS)
    return (
        F.when(any_contains(url, rules.URL_OFFICE), _verdict(True, "office", "url_office"))
        .when(any_contains(url, rules.URL_SHOWROOM), _verdict(True, "showroom", "url_showroom"))
        .when(excluded & ~has(rules.EXCLUDE_UNLESS), _verdict(False, "excluded", "exclude_keyword"))
        .when(has(rules.SHOWROOM_WORDS), _verdict(True, "showroom", "keyword_showroom"))
        .when(
            has(rules.BUSINESS_CENTER_WORDS) | has_bc_word(text),
            _verdict(True, "business_center", "keyword_bc"),
        )
        .when(has(rules.BUILDING_WORDS), _verdict(True, "building", "keyword_building"))
        .when(has(rules.OFFICE_WORDS), _verdict(True, "office", "keyword_office"))
        .when(
            retail & (first_floor | has(rules.FACADE_WORDS)),
            _verdict(True, "street_retail", "keyword_retail"),
        )
        .when(retail, _verdict(True, "retail", "keyword_retail"))
        .when(
            first_floor & has(rules.FIRST_FLOOR_WORDS),
            _verdict(True, "street_retail", "first_floor_commercial"),
        )
        .when(
            (property_type == "showroom") & no_showroom_words,
            _verdict(True, "free_purpose", "retag_bare_showroom"),
        )
        .when(
            property_type.isin(*rules.TARGET_SEGMENTS),
            _verdict(True, property_type, "property_type"),
        )
        .when(
            property_type.isin(*rules.EXCLUDED_TYPES),
            _verdict(False, property_type, "excluded_type"),
        )
        .when(
            has(rules.TARGET_WORDS),
            _verdict(True, F.coalesce(property_type, F.lit("other")), "target_keyword"),
        )
        .when(
            F.length(F.trim(blank_safe(title))) >= 5,
            _verdict(True, "free_purpose", "address_like_title"),
        )
        .otherwise(_verdict(False, "excluded", "no_target_signal"))
    )


def classify_segment(df: DataFrame, name: str = "segment_decision") -> DataFrame:
    decided = (
        df.withColumn("_seg_text", F.lower(join_text(F.col("title"), F.col("description"), F.col("address_raw"))))
        .withColumn("_seg_url", F.lower(blank_safe(F.col("url"))))
        .withColumn(
            name,
            segment_decision(
                F.col("_seg_text"), F.col("_seg_url"), F.col("title"),
                F.col("property_type"), F.col("floor"),
            ),
        )
        .drop("_seg_text", "_seg_url")
    )
    return computed_once(decided, name)


def keep_relevant(df: DataFrame, name: str = "segment_decision") -> DataFrame:
    """Relevant rows only; a target segment replaces the property type."""
    decided = classify_segment(df, name).where(F.col(f"{name}.relevant"))
    return decided.withColumn(
        "property_type",
        F.when(F.col(f"{name}.segment").isin(*rules.TARGET_SEGMENTS), F.col(f"{name}.segment"))
        .otherwise(F.col("property_type")),
    )
