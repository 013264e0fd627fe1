"""Identity of premises: rounding, price bands and the cross-portal fingerprint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotlens.functions.money import is_rent
from lotlens.functions.text import blank_safe, computed_once, normalize_address, normalize_text, phone_digits


def round_area(area: Column, step: float = 1.0) -> Column:
    return F.round(F.rint(area / step) * step, 1)


def round_coord(value: Column, digits: int = 4) -> Column:
    return F.bround(value, digits)


def price_band(price: Column, deal_type: Column) -> Column:
    """Logarithmic bucket label, 8 % wide for rent and 5 % for sale; '' without a price."""
    width = F.log(F.when(is_rent(deal_type), 1.08).otherwise(1.05))
    label = F.rint(F.exp(F.rint(F.log(price) / width) * width)).cast("decimal(38,0)").cast("string")
    return F.when(price > 0, label).otherwise("")


def _number_text(value: Column, pattern: str) -> Column:
    """Printed number; zero and null print as nothing."""
    return F.when(value != 0, F.format_string(pattern, value)).otherwise("")


def fingerprint(
    address: Column, area: Column, floor: Column, price: Column, property_type: Column,
    deal_type: Column, lat: Column, lon: Column, phone: Column,
) -> Column:
    addr = normalize_address(address)
    area_text = F.coalesce(_number_text(round_area(area), "%.1f"), F.lit(""))
    weak = (addr == "") | (area_text == "") | (lat.isNull() & lon.isNull())
    parts = [
        addr,
        area_text,
        blank_safe(floor.cast("string")),
        price_band(price, deal_type),
        normalize_text(property_type),
        normalize_text(deal_type),
        F.coalesce(_number_text(round_coord(lat), "%.4f"), F.lit("")),
        F.coalesce(_number_text(round_coord(lon), "%.4f"), F.lit("")),
        F.when(weak, phone_digits(phone)),
    ]
    return F.sha1(F.concat_ws("|", *parts))


def with_fingerprint(df: DataFrame, name: str = "fingerprint") -> DataFrame:
    c = F.col
    keyed = df.withColumn(name, fingerprint(
        c("address_raw"), c("area_sqm"), c("floor"), c("price"), c("property_type"),
        c("deal_type"), c("lat"), c("lon"), c("phone"),
    ))
    return computed_once(keyed, name)
