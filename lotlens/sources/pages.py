"""Raw portal pages -> listing observations, with column expressions only.

A page is one row; its JSON-LD blocks, anchors or cards live in arrays of that row until
they are exploded, so nothing but the de-duplication of links needs a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotlens.config import DEFAULT
from lotlens.functions import rules
from lotlens.functions.money import with_rate, with_total_price
from lotlens.functions.text import (
    any_contains, blank_safe, computed_once, count_contains, extract, extract_phones, guess_type, in_region, join_text,
    let, listing_id_from_url, none_if_empty, parse_area, parse_floor, street_address,
)
from lotlens.operators.relational import earliest_by, latest_by
from lotlens.schemas import CARD, EXTRA, TABLES

LD_SCRIPT = r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"
ANCHOR = r"(?is)<a\b[^>]*\bhref\s*=\s*[\"'][^\"']*[\"'][^>]*>.*?</a>"
HREF = r"(?is)^<a\b[^>]*\bhref\s*=\s*[\"']([^\"']*)[\"']"
STATE = r'window\.__PRERENDERED_STATE__=\s*"(\{.*\})"\s*;'
CARD_START = r"(?is)(?=<div\b(?=[^>]*\bclass\s*=\s*[\"'][^\"']*\bcatalog-card(?![\w-]))(?=[^>]*\bdata-catalog-item-id\s*=))"


def read_html_files(spark: SparkSession, path: str) -> DataFrame:
    """Fetched pages stored as one html file each."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("html"))


def drop_blocked_pages(pages: DataFrame) -> DataFrame:
    """Without challenge pages: two different markers on the page, or one that is a notable share of its visible text.

    The whole page is searched and its length plays no part.
    """
    def share(shown: Column) -> Column:
        rest = F.length(F.regexp_replace(shown, "|".join(rules.BLOCK_MARKERS), ""))
        return F.when(F.length(shown) > 0, 1 - rest / F.length(shown)).otherwise(1.0)

    marked = pages.withColumn("_page", F.lower(blank_safe(F.col("html")))).withColumn("_hits", count_contains(F.col("_page"), rules.BLOCK_MARKERS)).drop("_page")
    # the visible text is read only where it decides
    marked = marked.withColumn("_share", F.when(F.col("_hits") == 1, let(F.lower(text_of(blank_safe(F.col("html")))), share)))
    blocked = (F.col("_hits") >= 2) | ((F.col("_hits") == 1) & (F.col("_share") >= rules.BLOCK_SHARE))
    return computed_once(marked, "_hits", "_share").where(~blocked).drop("_hits", "_share")


# --- html helpers ---------------------------------------------------------------------------


def unescape(col: Column) -> Column:
    # The named entities that occur in portal markup.
    plain = col
    for entity, char in (("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    return F.when(col.contains("&"), plain).otherwise(col)


def text_of(html: Column) -> Column:
    """Visible text: scripts, styles, comments and tags out, blanks collapsed."""
    bare = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]+>", " ")
    return F.trim(F.regexp_replace(unescape(bare), r"(?U)\s+", " "))


def meta(html: Column, prop: str) -> Column:
    """Content of a meta tag, by property first, then by name."""
    tag = r"(?is)<meta\b(?=[^>]*\b%s\s*=\s*[\"']" + prop + r"[\"'])[^>]*?\bcontent\s*=\s*(?:\"([^\"]*)\"|'([^']*)')"

    def content(attribute: str) -> Column:
        return F.coalesce(extract(html, tag % attribute, 1), extract(html, tag % attribute, 2))

    return F.trim(unescape(F.coalesce(content("property"), content("name"))))


def with_meta(pages: DataFrame, prop: str, name: str | None = None) -> DataFrame:
    return pages.withColumn(name or prop.replace(":", "_"), meta(F.col("html"), prop))


def _absolute(href: Column, base: str) -> Column:
    """Absolute address without its query."""
    full = (
        F.when(href.rlike(r"(?i)^https?://"), href)
        .when(href.startswith("//"), F.concat(F.lit("https:"), href))
        .when(href.startswith("/"), F.concat(F.lit(base), href))
        .otherwise(F.concat(F.lit(base + "/"), href))
    )
    return F.regexp_extract(full, r"^[^?]*", 0)


# --- JSON-LD ------------------------------------------------------------------------------------


def json_blocks(html: Column) -> Column:
    """All JSON-LD objects of a page; a top-level array counts as its elements, bad JSON as none."""
    parsed = F.transform(
        F.regexp_extract_all(html, F.lit(LD_SCRIPT), F.lit(1)), lambda s: F.try_parse_json(F.trim(s)))
    lists = F.transform(parsed, lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v)))
    return F.filter(F.flatten(lists), lambda v: v.isNotNull() & is_object(v))


def is_object(v: Column) -> Column:
    return get(v, "$", "struct<>").isNotNull()


def get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def block_types(block: Column) -> Column:
    """Lower-case @type names of a block (text or list)."""
    many = get(block, "$['@type']", "array<string>")
    one = F.array(F.coalesce(get(block, "$['@type']"), F.lit("")))
    return F.transform(F.coalesce(many, one), lambda t: F.lower(t))


def has_type(block: Column, *names: str) -> Column:
    return F.arrays_overlap(block_types(block), F.array(*[F.lit(n.lower()) for n in names]))


def extract_json_ld(pages: DataFrame) -> DataFrame:
    """One row per JSON-LD block: page columns, ``block_no`` and ``block``."""
    return pages.select("*", F.posexplode(json_blocks(F.col("html"))).alias("block_no", "block"))


def json_ld_of_type(blocks: DataFrame, *types: str) -> DataFrame:
    return blocks.where(has_type(F.col("block"), *types))


def postal_address(address: Column) -> Column:
    """Address text: a plain string, or street, locality and region of an address object."""
    plain = F.when(~is_object(address), none_if_empty(F.trim(get(address, "$"))))
    parts = [none_if_empty(F.trim(get(address, f"$.{p}"))) for p in ("streetAddress", "addressLocality", "addressRegion")]
    return F.when(is_object(address), none_if_empty(F.concat_ws(", ", *parts))).otherwise(plain)


def geo(block: Column) -> tuple[Column, Column]:
    """(lat, lon) of a block; an exchanged pair is put right."""
    lat, lon = get(block, "$.latitude", "double"), get(block, "$.longitude", "double")
    return fix_geo(lat, lon)


def fix_geo(lat: Column, lon: Column) -> tuple[Column, Column]:
    swapped = lat.between(20, 40) & lon.between(44, 54)
    return F.when(swapped, lon).otherwise(lat), F.when(swapped, lat).otherwise(lon)


def first_offer(block: Column) -> Column:
    """First offer object of a block."""
    def object_of(path: str) -> Column:
        return let(get(block, path, "variant"), lambda v: F.when(is_object(v), v))

    return F.coalesce(object_of("$.offers"), object_of("$.offers[0]"))


def offer_price(offer: Column) -> tuple[Column, Column]:
    """(price, currency) of an offer within sane bounds; a non-numeric price is null here."""
    price = let(get(offer, "$.price", "double"), lambda value: F.when((value > 0) & (value <= DEFAULT.max_price), value))
    cur = let(F.upper(get(offer, "$.priceCurrency")), lambda c: F.when(c == "GRN", "UAH").otherwise(none_if_empty(c)))
    return price, cur


def offer_fields(blocks: DataFrame) -> DataFrame:
    """Address, geo and offer fields of every JSON-LD block."""
    b = F.col("block")
    offer = first_offer(b)
    lat, lon = geo(get(b, "$.geo", "variant"))
    price, cur = offer_price(offer)
    return blocks.withColumns({
        "address": postal_address(get(b, "$.address", "variant")), "lat": lat, "lon": lon,
        "price": price, "currency": cur, "availability": get(offer, "$.availability"),
    })


def page_status(html: Column, blocks: Column) -> Column:
    """Status label of a detail page, first rule wins; null when nothing is said."""
    states = F.transform(
        F.flatten(F.transform(blocks, lambda b: F.coalesce(
            get(b, "$.offers", "array<variant>"), F.array(get(b, "$.offers", "variant"))))),
        lambda o: F.lower(blank_safe(get(o, "$.availability"))),
    )
    sold_out = F.exists(states, lambda a: a.contains("soldout") | a.contains("discontinued"))
    in_stock = F.exists(blocks, lambda b: blank_safe(get(b, "$.offers.availability")).contains("InStock"))
    def said(text: Column) -> Column:
        return (
            F.when(sold_out, "sold_or_unavailable")
            .when(text.rlike(rules.STATUS_SOLD_PATTERN), "sold")
            .when(text.rlike(rules.STATUS_RENTED_PATTERN), "rented")
            .when(text.contains("404") & F.replace(text, F.lit(" "), F.lit("")).contains('"statuscode":404'), "inactive_404")
            .when(any_contains(text, rules.STATUS_INACTIVE_WORDS), "inactive")
            .when(in_stock, "active")
        )

    return let(F.lower(html), said)


# --- list pages ---------------------------------------------------------------------------------



def _extra(**fields: Column) -> Column:
    names = [p.strip().split(" ", 1) for p in EXTRA[len("STRUCT<"):-1].split(", ")]
    return F.struct(*[fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in names])


def _card(**fields: Column) -> list[Column]:
    """Observation card columns in schema order; missing ones are null."""
    out = []
    for part in CARD.split(", "):
        name, kind = part.split()
        out.append(fields.get(name, F.lit(None)).cast(kind).alias(name))
    return out


def listings_from_json_ld(pages: DataFrame, source: str = "lun") -> DataFrame:
    """List pages that carry ItemList blocks: one card per element of all lists, in page order.

    The n-th element belongs to the n-th distinct public link; without one it gets a stable
    synthetic id.
    """
    ids = F.array_distinct(F.regexp_extract_all("html", F.lit(r"/realty/(\d{6,})"), F.lit(1)))
    lists = F.filter(json_blocks(F.col("html")), lambda b: F.exists(block_types(b), lambda t: t.contains("itemlist")))
    rows = pages.select(
        "deal_type", "zone", "fetched_at", F.col("url").alias("page_url"), ids.alias("_ids"),
        F.posexplode(F.flatten(F.transform(lists, lambda b: F.coalesce(
            get(b, "$.itemListElement", "array<variant>"), F.array().cast("array<variant>"))))).alias("_i", "_el"),
    ).withColumn("_item", get(F.col("_el"), "$.item", "variant")).where(is_object(F.col("_item")))
    item = F.col("_item")
    offer = first_offer(item)
    image = F.coalesce(get(item, "$.image[0]"), get(item, "$.image"), F.lit("None"))
    seed = F.concat_ws("|", F.coalesce(get(item, "$.name"), F.lit("None")), image, F.col("_i").cast("string"), "zone", "deal_type")
    public = F.get(F.col("_ids"), F.col("_i"))
    rows = rows.withColumns({
        "_ext": F.coalesce(public, F.concat(F.lit("ld-"), F.substring(F.sha1(seed), 1, 12))),
        "_public": public.isNotNull(), "_offer": offer, "_price_text": get(offer, "$.price"),
        "_address": postal_address(get(item, "$.address", "variant")),
    })
    rows = rows.withColumn("_plain", F.col("_price_text").isNull() | get(F.col("_offer"), "$.price", "double").isNotNull())
    # the words of a price count only where it is no number
    rows = with_total_price(rows, F.when(F.col("_plain"), "").otherwise(F.col("_price_text")), "_tp", "_tc")
    offer, ext, address, plain = F.col("_offer"), F.col("_ext"), F.col("_address"), F.col("_plain")
    price, cur = offer_price(offer)
    lat, lon = geo(get(item, "$.geo", "variant"))
    name = F.coalesce(none_if_empty(get(item, "$.name")), address, F.concat(F.lit("LUN "), ext))
    size = get(item, "$.floorSize.value")
    avail = blank_safe(get(offer, "$.availability"))
    locality = get(item, "$.address.addressLocality")
    return rows.select("page_url", F.col("_i").alias("position"), *_card(
        source=F.lit(source), external_id=ext,
        url=F.when(F.col("_public"), F.concat(F.lit("https://lun.ua/realty/"), ext)).otherwise(
            F.concat(F.lit("https://lun.ua/"), F.col("deal_type"), F.lit("/kyiv/commercial#item-"), ext)),
        deal_type=F.col("deal_type"), title=name, property_type=guess_type(name),
        price=F.when(plain, price).otherwise(F.col("_tp")),
        currency=F.upper(F.coalesce(F.when(plain, cur).otherwise(F.col("_tc")), F.lit("UAH"))),
        area_sqm=F.coalesce(size.try_cast("double"), parse_area(size)), address_raw=address,
        district=get(offer, "$.areaServed.name"),
        city=F.coalesce(none_if_empty(locality), F.when(F.col("zone") == "kyiv", "Київ").otherwise("Київська область")),
        lat=lat, lon=lon,
        source_status_raw=F.when(avail.contains("InStock"), "active").when(offer.isNotNull(), avail),
    ), _extra(zone=F.col("zone"), skip_detail=~F.col("_public"), from_json_ld=F.lit(True)).alias("extra"),
        F.col("fetched_at").alias("seen_at"))


def listings_from_state_json(
    pages: DataFrame, source: str = "olx", base: str = "https://www.olx.ua", ads: Column | None = None,
) -> DataFrame:
    """List pages that embed their state as an (escaped) JSON string: one card per ad; ``ads`` are those of a page, if already read."""
    rows = pages.select(
        "deal_type", "fetched_at", F.col("url").alias("page_url"),
        F.posexplode(_state_ads(F.col("html")) if ads is None else ads).alias("position", "_ad"),
    )
    ad = F.col("_ad")
    title = F.trim(blank_safe(get(ad, "$.title")))
    link = F.coalesce(none_if_empty(get(ad, "$.url")), none_if_empty(get(ad, "$.urlPath")))
    params = get(ad, "$.params", "array<struct<key:string,normalizedValue:string,value:string>>")

    def param(key: str) -> Column:
        return F.get(F.filter(params, lambda p: (p["key"] == key) & (blank_safe(p["normalizedValue"]) != "")), 0)

    area, floor = param("total_area"), param("floor")
    district, city = none_if_empty(get(ad, "$.location.districtName")), get(ad, "$.location.cityName")
    city = F.coalesce(none_if_empty(city), F.lit("Київ"))
    url = _absolute(link, base)
    ext = get(ad, "$.id")
    return rows.where(_usable_ad(ad)).select("page_url", "position", *_card(
        source=F.lit(source), external_id=ext, url=url, deal_type=F.col("deal_type"), title=title,
        description=none_if_empty(get(ad, "$.description")),
        property_type=guess_type(F.concat_ws(" ", title, url)),
        price=get(ad, "$.price.regularPrice.value", "double"),
        currency=F.upper(F.coalesce(none_if_empty(get(ad, "$.price.regularPrice.currencyCode")), F.lit("UAH"))),
        area_sqm=F.coalesce(area["normalizedValue"].try_cast("double"), parse_area(area["value"])),
        floor=floor["normalizedValue"].try_cast("double").cast("int"),
        address_raw=F.concat_ws(", ", district, city), city=city,
        lat=get(ad, "$.map.lat", "double"), lon=get(ad, "$.map.lon", "double"),
    ), _extra(snippet=title, olx_status=get(ad, "$.status"), seller=get(ad, "$.user.name")).alias("extra"),
        F.col("fetched_at").alias("seen_at"))


@dataclass(frozen=True)
class LinkRule:
    """How a portal's listing links look on a list page."""

    source: str
    base: str
    href: str
    id_pattern: str | None = None
    min_title: int = 1
    region_only: bool = False
    sale_currency: str = "USD"
    rent_currency: str = "UAH"
    street_chars: int = 40
    fill_title: bool = False


# --- Fixed values: link shapes of the portals ----------------------------------------------
LINK_RULES = {
    "domria": LinkRule("domria", "https://dom.ria.com", r"realty-|realty.*\d{6,}", min_title=5, region_only=True),
    "olx": LinkRule("olx", "https://www.olx.ua", r"/d/|ID", min_title=8, sale_currency="UAH"),
    "rieltor": LinkRule(
        "rieltor", "https://rieltor.ua", r"/commercials-(?:sale|rent)/view/\d+", r"/commercials-(?:sale|rent)/view/(\d+)",
        min_title=0, street_chars=50, fill_title=True),
}


def page_anchors(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per anchor: ``page_url``, kept columns, position, href and text."""
    tag = F.col("_a")
    anchors = pages.select(
        F.col("url").alias("page_url"), *keep,
        F.posexplode(F.regexp_extract_all("html", F.lit(ANCHOR), F.lit(0))).alias("position", "_a"),
    ).select("page_url", *keep, "position", "_a", unescape(F.regexp_extract(tag, HREF, 1)).alias("href"))
    return computed_once(anchors, "href").withColumn("text", text_of(tag)).drop("_a")


def listings_from_anchors(pages: DataFrame, rule: LinkRule) -> DataFrame:
    """Listing links of list pages; the anchor text gives title, price, area and address."""
    rows = page_anchors(pages, ("deal_type", "fetched_at")).where(F.col("href").rlike(rule.href))
    rows = computed_once(rows.withColumn("_url", _absolute(F.col("href"), rule.base)), "_url")
    if rule.region_only:
        rows = rows.where(in_region(F.col("_url")))
    ext = extract(F.col("_url"), rule.id_pattern) if rule.id_pattern else listing_id_from_url(F.col("_url"))
    rows = computed_once(rows.withColumn("_ext", ext), "_ext").where(F.col("_ext").isNotNull())
    rows = earliest_by(rows, ["page_url", "_ext"], [F.col("position")])
    if rule.fill_title:
        short = F.length("text") < 3
        rows = rows.withColumn("text", F.when(short, F.concat(F.lit(f"{rule.source.upper()} "), F.col("_ext"))).otherwise(F.col("text")))
    rows = rows.where(F.length("text") >= rule.min_title)
    rows = with_rate(with_total_price(rows, F.col("text"), "_price", "_cur"), F.col("text"), "_rate", "_rcur")
    text, url = F.col("text"), F.col("_url")
    default = F.when(F.col("deal_type") == "sale", rule.sale_currency).otherwise(rule.rent_currency)
    street = street_address(text, rule.street_chars)
    address = {
        "domria": F.coalesce(street, text),
        "olx": F.coalesce(F.trim(extract(text, r"((?:Київ|Киев|Київська область)[^|]*)")), F.lit("Київ")),
    }.get(rule.source, F.coalesce(street, F.trim(extract(text, r"(Ки[єе]в[^\|]{5,})"))))
    extra = _extra(snippet=text) if rule.source == "olx" else _extra(list_only=F.lit(True))
    detailed = rule.source == "rieltor"
    return rows.select("page_url", "position", *_card(
        source=F.lit(rule.source), external_id=F.col("_ext"), url=url, deal_type=F.col("deal_type"),
        title=text, property_type=guess_type(F.concat_ws(" ", text, url)), price=F.col("_price"),
        currency=F.coalesce(F.col("_cur"), default), price_per_sqm=F.col("_rate") if detailed else F.lit(None),
        area_sqm=parse_area(text), floor=parse_floor(text) if detailed else F.lit(None), address_raw=address,
        district=text_district(text) if detailed else F.lit(None), city=F.lit("Київ"),
        phone=F.get(extract_phones(text), 0) if detailed else F.lit(None),
    ), extra.alias("extra"), F.col("fetched_at").alias("seen_at"))


def text_district(text: Column) -> Column:
    """District named in a card: a known name, else the word before the district mark."""
    def known(low: Column) -> Column:
        return F.coalesce(*[F.when(low.contains(name.lower()), name) for name, _ in rules.DISTRICTS])

    return F.coalesce(let(F.lower(text), known), extract(text, r"([А-Яа-яІіЇїЄєҐґ'’\-]+)\s*р-н"))


def first_element(html: Column) -> Column:
    """The element a text starts with, up to its own closing tag (elements of the same name may nest); null if it is never closed."""
    def cut(whole: Column) -> Column:
        def step(seen: Column, piece: Column) -> Column:
            depth = F.when(seen["depth"] == 0, 0).otherwise(seen["depth"] + F.when(piece.startswith("</"), -1).otherwise(1))
            return F.struct(depth.alias("depth"), (seen["size"] + F.when(depth > 0, F.length(piece)).otherwise(0)).alias("size"))

        # cut before tags of its own name only
        own = F.concat(F.lit("(?i)(?=</?"), F.regexp_extract(whole, r"^<(\w+)", 1), F.lit(r"(?!\w))"))
        return let(F.split(whole, own), lambda pieces: let(F.aggregate(
            F.slice(pieces, F.lit(2), F.size(pieces)), F.struct(F.lit(1).alias("depth"), F.length(F.get(pieces, F.lit(0))).alias("size")), step,
        ), lambda end: F.when(end["depth"] == 0, F.substring(whole, F.lit(1), end["size"]))))

    def up_to_own(whole: Column) -> Column:
        """Most elements hold none of their own name: cut before the first tag of that name, if it closes."""
        head = F.regexp_extract(whole, r"(?is)^(<(\w++).*?)</?\2(?!\w)", 1)
        return let(head, lambda h: F.when(
            (h != "") & (F.substring(whole, F.length(h) + 1, F.lit(2)) == "</"), h).otherwise(cut(whole)))

    return let(html, up_to_own)


def _class_text(html: Column, name: str) -> Column:
    opened = extract(html, rf"(?is)<\w+\b[^>]*\bclass\s*=\s*[\"'][^\"']*\b{name}(?![\w-])[^\"']*[\"'][^>]*>.*", 0)
    return text_of(first_element(opened))


def listings_from_cards(pages: DataFrame, source: str = "rieltor", base: str = "https://rieltor.ua") -> DataFrame:
    """Catalog pages made of cards with an item id: one listing per card, which ends at its closing tag (else at the next card)."""
    rows = pages.select(
        "deal_type", "fetched_at", F.col("url").alias("page_url"), F.posexplode(F.split("html", CARD_START)).alias("position", "_card"),
    ).where(F.col("_card").rlike(CARD_START))
    rows = computed_once(rows.withColumn("_card", F.coalesce(first_element(F.col("_card")), "_card")), "_card")
    card = F.col("_card")
    rows = rows.withColumns({
        "_ext": none_if_empty(F.trim(extract(card, r"(?is)^<div\b[^>]*\bdata-catalog-item-id\s*=\s*[\"']([^\"']*)[\"']"))),
        "_href": extract(card, r"(?is)<a\b[^>]*\bhref\s*=\s*[\"']([^\"']*/commercials-[^\"']*/view/[^\"']*)[\"']"),
    })
    rows = computed_once(rows, "_ext", "_href").where(F.col("_ext").isNotNull() & F.col("_href").isNotNull()).withColumns({
        "_label": F.trim(unescape(blank_safe(extract(card, r"(?is)^<div\b[^>]*\bdata-label\s*=\s*[\"']([^\"']*)[\"']")))),
        "_address": none_if_empty(_class_text(card, "catalog-card-address")),
        "_desc": _class_text(card, "catalog-card-description"),
        "_local": text_of(card),
    })
    price_text = F.coalesce(none_if_empty(_class_text(card, "catalog-card-price-title")), F.col("_label"))
    rate_text = F.coalesce(none_if_empty(_class_text(card, "catalog-card-price-details")), price_text)
    rows = with_rate(with_total_price(rows, price_text, "_price", "_cur"), rate_text, "_rate", "_rcur")
    local, address = F.col("_local"), F.col("_address")
    title = F.coalesce(none_if_empty(F.trim(join_text(address, F.col("_desc")))), F.concat(F.lit("RIELTOR "), F.col("_ext")))
    return rows.select("page_url", "position", *_card(
        source=F.lit(source), external_id=F.col("_ext"), url=_absolute(F.col("_href"), base), deal_type=F.col("deal_type"),
        title=title, property_type=guess_type(F.concat_ws(" ", title, local)), price=F.col("_price"),
        currency=F.coalesce(F.col("_cur"), F.when(F.col("deal_type") == "sale", "USD").otherwise("UAH")),
        price_per_sqm=F.col("_rate"), area_sqm=parse_area(local), floor=parse_floor(local),
        address_raw=F.coalesce(address, street_address(local, 50)), district=text_district(local), city=F.lit("Київ"),
        phone=F.get(extract_phones(local), 0),
    ), _extra(list_only=F.lit(True)).alias("extra"), F.col("fetched_at").alias("seen_at"))


# --- detail pages -------------------------------------------------------------------------------

# JSON-LD types each portal describes a listing with.
DETAIL_TYPES = {
    "domria": ("Product", "LocalBusiness"),
    "olx": ("Product", "Offer", "Apartment", "Place", "LocalBusiness"),
}


def _last(blocks: Column, value) -> Column:
    """Value of the last block that has one."""
    return F.try_element_at(F.filter(F.transform(blocks, value), lambda x: x.isNotNull()), F.lit(-1))


def detail_fields(pages: DataFrame) -> DataFrame:
    """One row per detail page, of several fetches the latest: source, url and all fields any portal policy reads (``d_*``)."""
    html, source = F.col("html"), F.col("source")
    pages = latest_by(pages, ["source", "url"], [F.col("fetched_at"), F.xxhash64("html")])
    rows = pages.withColumn("_all", json_blocks(html)).withColumn("d_status", page_status(html, F.col("_all")))
    typed = F.filter(F.col("_all"), lambda b: F.when(source == "domria", has_type(b, *DETAIL_TYPES["domria"]))
                     .when(source == "olx", has_type(b, *DETAIL_TYPES["olx"])).otherwise(F.lit(True)))
    rows = rows.withColumn("_blocks", F.when(source == "rieltor", F.array().cast("array<variant>")).otherwise(typed))
    blocks = F.col("_blocks")

    def offer_of(b: Column) -> Column:
        own = F.when((source == "olx") & has_type(b, "Offer"), b)
        return F.coalesce(first_offer(b), own)

    def priced(o: Column) -> Column:
        price, currency = offer_price(o)
        both = F.struct(price.alias("price"), currency.alias("currency"))
        return let(both, lambda x: F.when(x["price"].isNotNull(), x))

    def placed(b: Column) -> Column:
        lat, lon = geo(get(b, "$.geo", "variant"))
        return let(F.struct(lat.alias("lat"), lon.alias("lon")), lambda x: F.when(x["lat"].isNotNull(), x))

    crumbs = F.flatten(F.transform(
        F.filter(F.col("_all"), lambda b: has_type(b, "BreadcrumbList")),
        lambda b: F.transform(
            F.coalesce(get(b, "$.itemListElement", "array<variant>"), F.array().cast("array<variant>")),
            lambda e: F.coalesce(none_if_empty(get(e, "$.name")), get(e, "$.item.name"))),
    ))
    district_crumbs = F.filter(crumbs, lambda n: F.lower(n).contains("район") | F.lower(n).endswith("кий"))
    rows = rows.withColumn("_offers", F.transform(blocks, offer_of))
    offers, served = F.col("_offers"), F.col("d_served")
    rows = rows.withColumn("d_served", _last(offers, lambda o: get(o, "$.areaServed"))).withColumns({
        "d_title": meta(html, "og:title"), "d_description": meta(html, "og:description"),
        "d_phones": extract_phones(html), "d_text": text_of(html),
        "d_ld_name": _last(blocks, lambda b: let(get(b, "$.name"), none_if_empty)),
        "d_ld_description": _last(blocks, lambda b: let(get(b, "$.description"), none_if_empty)),
        "d_address": _last(blocks, lambda b: let(get(b, "$.address", "variant"), postal_address)),
        "d_geo": _last(blocks, placed), "d_offer": _last(offers, priced),
        "d_crumb": F.try_element_at(district_crumbs, F.lit(-1)),
        "d_served_district": F.when(F.lower(served).contains("район"), extract(served, r"(?iu)район\s+([A-Za-zА-Яа-яІіЇїЄєҐґ'’\-]+)")),
        "d_seller": _last(offers, lambda o: let(get(o, "$.seller.name"), none_if_empty)),
        "d_offered": _last(offers, lambda o: get(o, "$.itemOffered")),
        "d_availability": _last(offers, lambda o: get(o, "$.availability")),
    })
    keep = [c for c in rows.columns if c.startswith("d_")]
    return rows.select("source", F.col("url").alias("page_url"), *keep)


def merge_details(listings: DataFrame, details: DataFrame) -> DataFrame:
    """Detail-page fields over list-card fields, each portal by its own field policy."""
    c = F.col
    rows = listings.alias("l").join(
        details.withColumnRenamed("source", "_dsource"), (c("source") == c("_dsource")) & (c("url") == c("page_url")), "left")
    lun, domria, olx, rieltor = (c("source") == s for s in ("lun", "domria", "olx", "rieltor"))
    hit = c("_dsource").isNotNull()
    og_title, og_desc = none_if_empty(c("d_title")), none_if_empty(c("d_description"))
    title = F.when(domria | olx, F.coalesce("d_ld_name", og_title, "title")).otherwise(F.coalesce(og_title, "title"))
    description = (
        F.when(domria, c("d_ld_description")).when(olx, F.coalesce("d_ld_description", og_desc, "description"))
        .otherwise(F.coalesce(og_desc, "description"))
    )
    rows = rows.withColumns({
        "_title": title, "_desc": description,
        "_tt": F.when(rieltor, blank_safe(og_title)).otherwise(""), "_bt": F.when(rieltor, c("d_text")).otherwise(""),
    })
    rows = with_total_price(with_total_price(rows, c("_tt"), "_p1", "_c1"), c("_bt"), "_p2", "_c2")
    rows = with_rate(with_rate(rows, c("_tt"), "_r1", "_rc1"), c("_bt"), "_r2", "_rc2")
    spoken = F.when(lun | rieltor, join_text(c("_title"), c("_desc"), c("d_text"))).otherwise(
        join_text(F.when(domria, c("d_offered")), c("_title"), c("_desc")))
    head = F.trim(F.regexp_replace(F.regexp_replace(
        F.trim(F.substring_index(c("_title"), "—", 1)), r"(?iu),?\s*\d[\d\s.,]*\s*(грн|\$|usd|uah|євро|eur).*$", ""),
        r"^[ ,]+|[ ,]+$", ""))
    ld_address = F.coalesce("d_address", "address_raw")
    longer = (head != "") & ((blank_safe(ld_address) == "") | (F.length(head) > F.length(ld_address)))
    rieltor_address = F.coalesce(
        street_address(c("_title"), 50), F.trim(extract(c("_title"), r"(Ки[єе]в[^\|]{5,})")),
        street_address(c("d_text"), 50), F.trim(extract(c("d_text"), r"(Ки[єе]в[^\|]{5,})")), c("address_raw"))
    address = F.when(lun & longer, head).when(rieltor, rieltor_address).when(
        domria, F.coalesce(ld_address, "d_served")).otherwise(ld_address)
    by_stock = F.when(c("d_availability").contains("SoldOut") | c("d_availability").contains("OutOfStock"), "sold_or_unavailable").when(
        c("d_availability").contains("InStock"), "active")
    status = F.when(domria, F.coalesce("d_status", by_stock)).otherwise(c("d_status"))
    said_agency = F.trim(extract(c("d_text"), r"(?iu)(?:агентство|АН|рієлтор|риелтор)[:\s]+([^\n|]{3,60})"))
    price = F.when(rieltor, F.coalesce("_p1", "_p2", "price")).otherwise(F.coalesce("d_offer.price", "price"))
    currency = F.when(rieltor, F.coalesce(F.when(c("_p1").isNotNull(), c("_c1")).otherwise(F.coalesce("_c2", "_c1")), c("currency"))).otherwise(
        F.coalesce("d_offer.currency", "currency"))
    area, floor = parse_area(spoken), parse_floor(spoken)
    new = {
        "title": c("_title"), "description": c("_desc"), "address_raw": address,
        "district": F.coalesce(F.when(lun, c("d_crumb")).when(domria, c("d_served_district")).when(rieltor, text_district(c("d_text"))), c("district")),
        "city": F.when(lun, c("city")).otherwise(F.coalesce(none_if_empty(c("city")), F.lit("Київ"))),
        "lat": F.when(c("d_geo").isNotNull(), c("d_geo.lat")).otherwise(c("lat")),
        "lon": F.when(c("d_geo").isNotNull(), c("d_geo.lon")).otherwise(c("lon")),
        "price": price, "currency": currency,
        "price_per_sqm": F.when(rieltor, F.coalesce("_r1", "_r2", "price_per_sqm")).otherwise(c("price_per_sqm")),
        "area_sqm": F.when(rieltor, F.coalesce(area, "area_sqm")).otherwise(F.coalesce(F.when(c("area_sqm") != 0, c("area_sqm")), area)),
        "floor": F.when(rieltor, F.coalesce(floor, "floor")).otherwise(F.coalesce("floor", floor)),
        "phone": F.coalesce(F.get("d_phones", 0), "phone"),
        "agency": F.when(domria, F.coalesce("d_seller", "agency")).when(rieltor, F.coalesce(said_agency, "agency")).otherwise(c("agency")),
        "source_status_raw": F.coalesce(status, "source_status_raw"),
        "property_type": guess_type(join_text(c("_title"), c("_desc"))),
        "extra": F.struct(*[
            {"detail": F.lit(True), "phones": c("d_phones"), "status": status}.get(f, c(f"extra.{f}")).alias(f)
            for f in listings.schema["extra"].dataType.names
        ]),
    }
    return rows.select(*[
        F.when(hit, new[col]).otherwise(F.col(f"l.{col}")).alias(col) if col in new else F.col(f"l.{col}")
        for col in listings.columns
    ])


def _state_ads(html: Column) -> Column:
    """Ads of the embedded page state (text or escaped text); null when the page has none."""
    def ads(raw: Column) -> Column:
        # an object whose first key begins with a backslash is escaped text and no JSON
        plain = F.when(~raw.rlike(r"^\{\s*\\"), F.try_parse_json(raw))
        inner = get(F.try_parse_json(F.concat(F.lit('"'), raw, F.lit('"'))), "$")
        return get(F.coalesce(plain, F.try_parse_json(inner)), "$.listing.listing.ads", "array<variant>")

    return let(F.when(html.contains("__PRERENDERED_STATE__"), extract(html, STATE)), ads)


def _usable_ad(ad: Column) -> Column:
    link = F.coalesce(none_if_empty(get(ad, "$.url")), none_if_empty(get(ad, "$.urlPath")))
    return (blank_safe(get(ad, "$.id")) != "") & link.isNotNull() & (F.length(F.trim(blank_safe(get(ad, "$.title")))) >= 8)


def _olx(pages: DataFrame) -> DataFrame:
    """Ads of the page state; anchors only on pages whose state names no usable ad."""
    routed = computed_once(pages.withColumn("_ads", _state_ads(F.col("html"))), "_ads")
    filled = F.coalesce(F.exists("_ads", _usable_ad), F.lit(False))
    return listings_from_state_json(routed.where(filled), ads=F.col("_ads")).unionByName(
        listings_from_anchors(routed.where(~filled).drop("_ads"), LINK_RULES["olx"]))


def _rieltor(pages: DataFrame) -> DataFrame:
    """Catalog cards; anchors only on pages without any card."""
    carded = F.col("html").rlike(CARD_START)
    return listings_from_cards(pages.where(carded)).unionByName(
        listings_from_anchors(pages.where(~carded), LINK_RULES["rieltor"]))


SOURCES = {
    "lun": listings_from_json_ld,
    "domria": lambda pages: listings_from_anchors(pages, LINK_RULES["domria"]),
    "olx": _olx,
    "rieltor": _rieltor,
}


def observations_from_pages(pages: DataFrame) -> DataFrame:
    """List pages of all portals as one batch of cards."""
    good = drop_blocked_pages(pages.where((F.col("kind") == "list") & F.col("source").isin(*SOURCES)))
    out = None
    for source, rule in SOURCES.items():
        rows = rule(good.where(F.col("source") == source))
        out = rows if out is None else out.unionByName(rows)
    return out
