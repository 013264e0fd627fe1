"""Text, identity and page-extraction rules over whole tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from lotlens.functions import identity as I
from lotlens.functions import money as Y
from lotlens.functions import rules as R
from lotlens.functions import text as T
from lotlens.functions.segments import classify_segment, keep_relevant
from lotlens.operators import quality as Q
from lotlens.operators.state import new_fingerprints
from lotlens.plans.check_sql import ACTIVE, LV, rnd, usd, with_
from lotlens.plans.market_queries import RATES
from lotlens.plans.registry import query
from lotlens.plans.search_queries import AUDIT_ROWS, _audit_rows, _with_extra, audit_sql
from lotlens.plans.views import listing_view, table
from lotlens.session import spread
from lotlens.sources import pages as P
from lotlens.sources.tables import conform



def any_sql(text: str, words) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(text, w.replace("'", "''")) for w in words) + ")"


def _word_sql(text: str, words: str) -> str:
    return rf"regexp_matches({text}, '(^|[^\p{{L}}\p{{N}}_])({words})($|[^\p{{L}}\p{{N}}_])')"


# --- identity -----------------------------------------------------------------------------------


@query("names_normalized", "SELECT p_partkey, p_name || ' x''s ' || lower(p_brand) AS name FROM part")
def names_normalized(spark, root):
    raw = F.concat(F.lit("  "), F.upper("p_name"), F.lit("\t X`S  "), F.col("p_brand"), F.lit(" "))
    return table(spark, root, "part").select("p_partkey", T.normalize_text(raw).alias("name"))


@query("addresses_normalized", "SELECT p_partkey, p_name || ' ' || p_size || ' 2 б' AS address FROM part")
def addresses_normalized(spark, root):
    raw = F.concat(F.lit("м.Київ, вул. "), F.upper("p_name"), F.lit(", "), F.col("p_size").cast("string"), F.lit("/2-Б; "), F.lit("Київська обл."))
    cleaned = F.regexp_replace(T.normalize_address(raw), "^м ", "")
    return table(spark, root, "part").select("p_partkey", cleaned.alias("address"))


@query("areas_and_coordinates_rounded", "SELECT p_partkey, round_even(p_retailprice / 5, 0) * 5 AS area, round_even(p_retailprice / 4, 1) AS coord FROM part")
def rounded_areas(spark, root):
    price = F.col("p_retailprice")
    return table(spark, root, "part").select("p_partkey", I.round_area(price, 5.0).alias("area"), I.round_coord(price / 4, 1).alias("coord"))


BAND = "CAST(CAST(round_even(exp(round_even(ln(p_retailprice) / ln({w}), 0) * ln({w})), 0) AS BIGINT) AS VARCHAR)"
BAND_SQL = f"CASE WHEN p_size % 2 = 0 THEN {BAND.format(w='1.05::DOUBLE')} ELSE {BAND.format(w='1.08::DOUBLE')} END"


@query("price_bands", f"SELECT p_partkey, {BAND_SQL} AS band FROM part")
def price_bands(spark, root):
    deal = F.when(F.col("p_size") % 2 == 0, "sale").otherwise("rent")
    return table(spark, root, "part").select("p_partkey", I.price_band(F.col("p_retailprice"), deal).alias("band"))


FINGER = f"""sha1(concat_ws('|', CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_name || ' ' || p_size END, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE printf('%.1f', CAST(p_size AS DOUBLE)) END,
  CAST(p_size % 9 AS VARCHAR), {BAND_SQL}, lower(p_type), CASE WHEN p_size % 2 = 0 THEN 'sale' ELSE 'rent' END, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE printf('%.4f', 50 + p_size / 100.0) END,
  CASE WHEN p_partkey % 3 = 0 THEN '' ELSE printf('%.4f', 30 + p_size / 100.0) END, CASE WHEN p_partkey % 3 = 0 OR p_partkey % 4 = 0 OR p_partkey % 5 = 0 THEN '050' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') END))"""


def _cards(spark, root):
    k, size = F.col("p_partkey"), F.col("p_size")
    place = k % 3 != 0
    return table(spark, root, "part").select(
        k.alias("p_partkey"), F.when(k % 4 != 0, F.concat(F.col("p_name"), F.lit(", "), size.cast("string"))).alias("address_raw"),
        F.when(k % 5 != 0, size.cast("double")).alias("area_sqm"), (size % 9).alias("floor"), F.col("p_retailprice").alias("price"),
        F.col("p_type").alias("property_type"), F.when(size % 2 == 0, "sale").otherwise("rent").alias("deal_type"),
        F.when(place, 50 + size / 100).alias("lat"), F.when(place, 30 + size / 100).alias("lon"),
        F.concat(F.lit("+38050"), F.lpad(k.cast("string"), 7, "0")).alias("phone"),
    )


@query("fingerprints", f"SELECT p_partkey, {FINGER} AS fingerprint FROM part")
def fingerprints(spark, root):
    return I.with_fingerprint(_cards(spark, root)).select("p_partkey", "fingerprint")


@query("fingerprints_without_premises", f"SELECT DISTINCT {FINGER} AS fingerprint FROM part WHERE {FINGER} NOT IN (SELECT {FINGER} FROM part WHERE p_partkey % 3 = 1)")
def fresh_fingerprints(spark, root):
    rows = I.with_fingerprint(_cards(spark, root), "property_key")
    known = rows.where(F.col("p_partkey") % 3 == 1).select(F.col("property_key").alias("fingerprint"))
    return new_fingerprints(rows, known)


# --- numbers, prices, areas in text -----------------------------------------------------------------


@query("numbers_parsed", """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_retailprice WHEN 1 THEN 12000 + p_partkey % 1000
  WHEN 2 THEN 1000000 + (p_partkey % 1000) * 1000 WHEN 3 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS number FROM part""")
def numbers_parsed(spark, root):
    k, tail = F.col("p_partkey"), F.lpad((F.col("p_partkey") % 1000).cast("string"), 3, "0")
    text = (
        F.when(k % 5 == 0, F.translate(F.col("p_retailprice").cast("string"), ".", ","))
        .when(k % 5 == 1, F.concat(F.lit("12 "), tail)).when(k % 5 == 2, F.concat(F.lit("1."), tail, F.lit(".000")))
        .when(k % 5 == 3, F.lit("немає")).otherwise(F.col("p_size").cast("string"))
    )
    return table(spark, root, "part").select("p_partkey", T.to_number(text).alias("number"))


PRICE_TEXT_SQL = """pt AS (SELECT listing_id, CAST(o_totalprice AS BIGINT) + 5000 AS p, 10 + o_orderkey % 50 AS r, 30 + o_orderkey % 90 AS a, o_orderkey % 9 AS f FROM lv JOIN orders ON o_orderkey = listing_id)"""


def _price_text(spark, root):
    k = F.col("o_orderkey")
    rows = table(spark, root, "orders").select(
        k.alias("listing_id"), (F.rint("o_totalprice").cast("bigint") + 5000).alias("p"), (10 + k % 50).alias("r"), (30 + k % 90).alias("a"), (k % 9).alias("f"))
    rows = spread(rows)
    spaced = F.replace(F.format_number("p", 0), F.lit(","), F.lit(" "))
    k = F.col("listing_id")
    text = (
        F.when(k % 5 == 0, F.concat(F.lit("Продаж офісу "), spaced, F.lit(" $ / міс")))
        .when(k % 5 == 1, F.concat(spaced, F.lit(" $ "), F.col("r").cast("string"), F.lit(" $/м² вул. Лугова")))
        .when(k % 5 == 2, F.concat(F.lit("Оренда "), spaced, F.lit(" грн, "), F.col("a").cast("string"), F.lit(" м², "), F.col("f").cast("string"), F.lit(" поверх")))
        .when(k % 5 == 3, F.concat(F.lit("EUR "), F.col("p").cast("string"), F.lit(", поверх: "), F.col("f").cast("string")))
        .otherwise(F.concat(F.lit("ставка "), F.col("r").cast("string"), F.lit(" грн/м2, площа "), F.col("a").cast("string"), F.lit(",5 кв. м")))
    )
    return rows.withColumn("text", text)


# Two more shapes hold several prices: a price in USD with the same in UAH, and digits glued to a price.
@query("total_prices_from_text", with_(LV, PRICE_TEXT_SQL, body="""SELECT listing_id, 'one' AS shape, CASE WHEN listing_id % 5 < 4 THEN CAST(p AS DOUBLE) END AS text_total,
  CASE listing_id % 5 WHEN 2 THEN 'UAH' WHEN 3 THEN 'EUR' WHEN 4 THEN 'UAH' ELSE 'USD' END AS text_currency FROM pt
UNION ALL SELECT listing_id, 'two', CAST(p AS DOUBLE), 'USD' FROM pt UNION ALL SELECT listing_id, 'four', CAST(p AS DOUBLE), 'USD' FROM pt
UNION ALL SELECT listing_id, 'glued', CAST(p % 900000 + 100000 AS DOUBLE), 'EUR' FROM pt"""))
def total_prices(spark, root):
    one = _price_text(spark, root)

    def spaced(n):
        return F.replace(F.format_number(n, 0), F.lit(","), F.lit(" "))

    dollars, local = spaced(F.col("p")), spaced(F.col("p") * 42)
    shapes = {
        "one": F.col("text"), "two": F.concat(dollars, F.lit(" $ "), local, F.lit(" грн")),
        "four": F.concat(F.lit("завдаток 900 € або 38 000 грн, разом "), local, F.lit(" грн, "), dollars, F.lit(" $")),
        "glued": F.concat(F.lit("17 17 "), spaced(F.col("p") % 900000 + 100000), F.lit(" € центр")),
    }
    texts = one.select("listing_id", F.explode(F.create_map(*[x for n, t in shapes.items() for x in (F.lit(n), t)])).alias("shape", "text"))
    return Y.with_total_price(texts, F.col("text")).select("listing_id", "shape", "text_total", "text_currency")


@query("rates_from_text", with_(LV, PRICE_TEXT_SQL, body="""SELECT listing_id, CASE WHEN listing_id % 5 IN (1, 4) THEN CAST(r AS DOUBLE) END AS text_rate,
  CASE listing_id % 5 WHEN 1 THEN 'USD' WHEN 4 THEN 'UAH' END AS text_rate_currency FROM pt"""))
def rates_from_text(spark, root):
    return Y.with_rate(_price_text(spark, root), F.col("text")).select("listing_id", "text_rate", "text_rate_currency")


@query("areas_and_floors_from_text", with_(LV, PRICE_TEXT_SQL, body="""SELECT listing_id, CASE listing_id % 5 WHEN 2 THEN CAST(a AS DOUBLE) WHEN 4 THEN a + 0.5 END AS area,
  CASE WHEN listing_id % 5 IN (2, 3) THEN CAST(f AS INTEGER) END AS floor FROM pt"""))
def areas_floors(spark, root):
    return T.with_area_floor(_price_text(spark, root), F.col("text"), "area", "floor").select("listing_id", "area", "floor")


@query("title_junk_stripped", with_(LV, body="SELECT listing_id, title FROM lv"))
def title_junk(spark, root):
    k = F.col("listing_id")
    junk = F.when(k % 3 == 0, F.lit("17 17 250 000 $ 2 790 $/м² ")).when(k % 3 == 1, F.lit("8 95 000 $ ")).otherwise(F.lit(""))
    return listing_view(spark, root).select("listing_id", T.strip_price_junk(F.concat(junk, "title")).alias("title"))


NORM = f"""nz AS (SELECT *, {usd('price', 'cur2')} AS u, {usd('price', 'cur2')} / area_sqm AS imp, CASE deal_type WHEN 'rent' THEN 3 ELSE 80 END AS fl,
    CASE WHEN implied IS NULL THEN price_per_sqm WHEN price_per_sqm IS NULL OR abs(price_per_sqm - price) / greatest(price, 1.0) < 0.02 THEN implied
      WHEN deal_type = 'rent' AND su > 70 AND iu <= 70 THEN implied WHEN abs(su - iu) / greatest(iu, 0.5) > 0.35 THEN implied ELSE price_per_sqm END AS cr FROM rates),
norm AS (SELECT listing_id, CASE WHEN price IS NULL OR area_sqm IS NULL THEN 'pass' WHEN imp >= fl THEN 'clean'
    WHEN (deal_type = 'rent' AND u > 70) OR (deal_type = 'sale' AND (u < 450 OR u > 10000)) THEN 'skip_expand_implausible_rate' ELSE 'expanded' END AS outcome, cur2, price, area_sqm, price_per_sqm, cr, imp, deal_type FROM nz)"""


def _normalized(spark, root):
    return Y.normalize_price(spread(listing_view(spark, root)))


@query("prices_normalized", with_(LV, RATES, NORM, body=f"""SELECT listing_id, CASE outcome WHEN 'expanded' THEN {rnd('price * area_sqm', 2)} ELSE price END AS price, cur2 AS currency,
  CASE outcome WHEN 'clean' THEN cr WHEN 'expanded' THEN coalesce(price_per_sqm, price) ELSE price_per_sqm END AS rate, outcome = 'expanded' AS reinterpreted,
  CASE outcome WHEN 'clean' THEN coalesce((deal_type = 'rent' AND imp > 70) OR (deal_type = 'sale' AND (imp < 450 OR imp > 10000)), false) ELSE outcome = 'skip_expand_implausible_rate' END AS suspicious FROM norm"""))
def prices_normalized(spark, root):
    n = F.col("price_norm")
    return _normalized(spark, root).select(
        "listing_id", n["price"].alias("price"), n["currency"].alias("currency"), n["price_per_sqm"].alias("rate"), n["reinterpreted"].alias("reinterpreted"), n["suspicious"].alias("suspicious"))


@query("price_fix_outcomes", with_(LV, RATES, NORM, body="SELECT CASE WHEN outcome IN ('pass', 'clean') THEN '' ELSE outcome END AS outcome, count(*) AS n FROM norm GROUP BY 1"))
def price_fix_outcomes(spark, root):
    fixed = Q.fix_prices(_with_extra(listing_view(spark, root), opex=F.col("opex")))
    detail = F.col("fix.detail")
    return fixed.groupBy(F.when(detail.startswith("implied_psm_usd="), "expanded").otherwise(detail).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def _rates_of(rows: str, mark: str) -> str:
    """The rate rules of `RATES` over another table of listings."""
    out = RATES.replace("FROM lv", f"FROM {rows}")
    for name in ("rt0", "rt1", "rt2", "rates"):
        out = re.sub(rf"\b{name}\b", mark + name, out)
    return out


RATE_COLUMNS = "implied, implied_usd, cur2, iu, su, su0, sane_rate, rate_usd"
# Rows before the fix, what the rules say of the active ones, their rates under the new price, and their rates once more under the new rate.
REVIEW_SQL = f"""nn AS (SELECT listing_id, outcome, CASE outcome WHEN 'expanded' THEN {rnd('price * area_sqm', 2)} ELSE price END AS np, cur2 AS nc,
    CASE outcome WHEN 'clean' THEN cr WHEN 'expanded' THEN coalesce(price_per_sqm, price) ELSE price_per_sqm END AS nr,
    CASE outcome WHEN 'clean' THEN coalesce((deal_type = 'rent' AND imp > 70) OR (deal_type = 'sale' AND (imp < 450 OR imp > 10000)), false) ELSE outcome = 'skip_expand_implausible_rate' END AS susp FROM norm),
fx0 AS (SELECT au.* EXCLUDE ({RATE_COLUMNS}) REPLACE (np AS price, nc AS currency, nr AS price_per_sqm), au.price AS old_price, au.currency AS old_currency, au.price_per_sqm AS old_rate, outcome, susp
  FROM au JOIN nn USING (listing_id) WHERE {ACTIVE}),
{_rates_of('fx0', 'a_')},
fx1 AS (SELECT * EXCLUDE ({RATE_COLUMNS}) REPLACE (coalesce(sane_rate, price_per_sqm, old_rate) AS price_per_sqm) FROM a_rates),
{_rates_of('fx1', 'b_')},
fx AS (SELECT * REPLACE (CASE WHEN src = 'rieltor' THEN title ELSE ttl END AS ttl, deal_type = 'rent' AND odd AS flagged), flagged AS was_flagged, src = 'rieltor' AND ttl <> title AS retitled,
    old_price IS DISTINCT FROM price OR old_currency IS DISTINCT FROM currency OR old_rate IS DISTINCT FROM price_per_sqm AS moved
  FROM (SELECT *, susp OR coalesce((deal_type = 'rent' AND rate_usd > 70) OR (deal_type = 'sale' AND (rate_usd < 450 OR rate_usd > 10000)), false) AS odd FROM b_rates)),
done AS (SELECT status, deal_type, price, area_sqm, price_per_sqm, rate_usd, src, ttl, lnk, flagged FROM fx
  UNION ALL SELECT status, deal_type, price, area_sqm, price_per_sqm, rate_usd, src, ttl, lnk, flagged FROM au WHERE NOT ({ACTIVE}))"""


@query("price_review", with_(LV, RATES, AUDIT_ROWS, NORM, REVIEW_SQL, body=f"""SELECT 'before' AS step, metric, n FROM ({audit_sql('au')})
UNION ALL SELECT 'after', metric, n FROM ({audit_sql('done')})
UNION ALL SELECT 'fix', unnest(['touched', 'repaired_from_text', 'repaired_from_text_psm', 'title_cleaned']),
  unnest([count(*) FILTER (moved OR retitled OR outcome = 'expanded' OR odd OR was_flagged), 0, 0, count(*) FILTER (retitled)]) FROM fx"""))
def price_review(spark, root):
    return Q.review_prices(_audit_rows(spark, root), ["active", "relisted"])


# --- classification -------------------------------------------------------------------------------


def _type_sql(t: str) -> str:
    has = lambda words: any_sql(t, words)
    return f"""CASE WHEN {has(R.SHOWROOM_WORDS)} THEN 'showroom' WHEN {has(R.BUSINESS_CENTER_WORDS)} OR {_word_sql(t, 'бц')} THEN 'business_center' WHEN {has(R.BUILDING_WORDS)} THEN 'building'
  WHEN {has(R.GUESS_OFFICE)} THEN 'office' WHEN {has(R.GUESS_WAREHOUSE)} THEN 'warehouse' WHEN {has(R.GUESS_RETAIL)} AND {has(R.GUESS_STREET)} THEN 'street_retail' WHEN {has(R.GUESS_RETAIL)} THEN 'retail'
  WHEN {has(R.GUESS_INDUSTRIAL)} THEN 'industrial' WHEN {has(R.GUESS_LAND)} THEN 'land_commercial' WHEN {has(R.GUESS_FREE)} THEN 'free_purpose' ELSE 'other' END"""


@query("property_types_guessed", f"SELECT doc_id, {_type_sql('lower(text)')} AS property_type FROM documents")
def types_guessed(spark, root):
    return table(spark, root, "documents").select("doc_id", T.guess_type(F.col("text")).alias("property_type"))


# Titles built from parts: each p_type stands for a phrase of the market.
PHRASES = {
    "LARGE": "Оренда складу, логістика", "MEDIUM": "Офіс у центрі", "ECONOMY": "Торгове приміщення, фасад",
    "SMALL": "Магазин", "STANDARD": "Приміщення в БЦ", "PROMO": "",
}
TYPES = ("office", "retail", "showroom", "warehouse", "free_purpose")
PHRASE_SQL = "CASE p_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PHRASES.items()) + " END"
PARTS_SQL = f"""pl AS (SELECT p_partkey, {PHRASE_SQL} || ' ' || p_name AS title, CASE p_partkey % 5 {' '.join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TYPES))} END AS property_type,
  p_size % 4 AS floor, CASE p_partkey % 7 WHEN 0 THEN 'https://x.example/Ofis/1' WHEN 1 THEN 'https://x.example/showroom/1' ELSE 'https://x.example/item/1' END AS url FROM part)"""


def _segment_sql(t: str) -> str:
    has = lambda words: any_sql(t, words)
    targets = ", ".join(f"'{s}'" for s in R.TARGET_SEGMENTS)
    excluded = ", ".join(f"'{s}'" for s in R.EXCLUDED_TYPES)
    rules = [
        (any_sql("lower(url)", R.URL_OFFICE), "true", "'office'", "url_office"), (any_sql("lower(url)", R.URL_SHOWROOM), "true", "'showroom'", "url_showroom"),
        (f"({has(R.EXCLUDE_WORDS)} OR {_word_sql(t, 'сто')}) AND NOT {has(R.EXCLUDE_UNLESS)}", "false", "'excluded'", "exclude_keyword"),
        (has(R.SHOWROOM_WORDS), "true", "'showroom'", "keyword_showroom"), (f"({has(R.BUSINESS_CENTER_WORDS)} OR {_word_sql(t, 'бц')})", "true", "'business_center'", "keyword_bc"),
        (has(R.BUILDING_WORDS), "true", "'building'", "keyword_building"), (has(R.OFFICE_WORDS), "true", "'office'", "keyword_office"),
        (f"{has(R.RETAIL_WORDS)} AND (coalesce(floor = 1, false) OR {has(R.FACADE_WORDS)})", "true", "'street_retail'", "keyword_retail"), (has(R.RETAIL_WORDS), "true", "'retail'", "keyword_retail"),
        (f"coalesce(floor = 1, false) AND {has(R.FIRST_FLOOR_WORDS)}", "true", "'street_retail'", "first_floor_commercial"),
        (f"property_type = 'showroom' AND NOT {has(('шоурум', 'showroom'))}", "true", "'free_purpose'", "retag_bare_showroom"),
        (f"property_type IN ({targets})", "true", "property_type", "property_type"), (f"property_type IN ({excluded})", "false", "property_type", "excluded_type"),
        (has(R.TARGET_WORDS), "true", "coalesce(property_type, 'other')", "target_keyword"), ("length(trim(coalesce(title, ''))) >= 5", "true", "'free_purpose'", "address_like_title"),
    ]
    def chain(i, default):
        return "CASE " + " ".join(f"WHEN {r[0]} THEN " + (f"'{r[3]}'" if i == 3 else r[i]) for r in rules) + f" ELSE {default} END"

    return f"{chain(1, 'false')} AS relevant, {chain(2, chr(39) + 'excluded' + chr(39))} AS segment, {chain(3, chr(39) + 'no_target_signal' + chr(39))} AS reason"


SEG_SQL = f"seg AS (SELECT *, {_segment_sql('lower(title)')} FROM pl)"


def _parts(spark, root):
    phrase = F.create_map(*[F.lit(x) for pair in PHRASES.items() for x in pair])[F.col("p_type")]
    k = F.col("p_partkey")
    return table(spark, root, "part").select(
        k, F.concat(phrase, F.lit(" "), "p_name").alias("title"), F.element_at(F.array(*[F.lit(t) for t in TYPES]), (k % 5 + 1).cast("int")).alias("property_type"),
        (F.col("p_size") % 4).alias("floor"), F.when(k % 7 == 0, "https://x.example/Ofis/1").when(k % 7 == 1, "https://x.example/showroom/1").otherwise("https://x.example/item/1").alias("url"),
        F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("address_raw"),
    )


@query("segments_of_parts", with_(PARTS_SQL, SEG_SQL, body="SELECT p_partkey, relevant, segment, reason FROM seg"))
def segments_of_parts(spark, root):
    return classify_segment(_parts(spark, root)).select("p_partkey", "segment_decision.*")


DOC_SQL = "pl AS (SELECT doc_id, text AS title, NULL::VARCHAR AS property_type, doc_id % 3 AS floor, '' AS url FROM documents)"


@query("segments_of_documents", with_(DOC_SQL, SEG_SQL, body="SELECT doc_id, relevant, segment, reason FROM seg"))
def segments_of_documents(spark, root):
    null = F.lit(None).cast("string")
    rows = spread(table(spark, root, "documents")).select(
        "doc_id", F.col("text").alias("title"), null.alias("property_type"), (F.col("doc_id") % 3).cast("int").alias("floor"),
        null.alias("url"), null.alias("description"), null.alias("address_raw"))
    return classify_segment(rows).select("doc_id", "segment_decision.*")


TARGETS_SQL = ", ".join(f"'{s}'" for s in R.TARGET_SEGMENTS)


@query("relevant_parts", with_(PARTS_SQL, SEG_SQL, body=f"SELECT p_partkey, CASE WHEN segment IN ({TARGETS_SQL}) THEN segment ELSE property_type END AS property_type FROM seg WHERE relevant"))
def relevant_parts(spark, root):
    return keep_relevant(_parts(spark, root)).select("p_partkey", "property_type")


@query("parts_reclassified", with_(PARTS_SQL, SEG_SQL, body="SELECT segment AS property_type, count(*) AS n, count(*) FILTER (segment IS DISTINCT FROM property_type) AS retagged FROM seg WHERE relevant GROUP BY 1"))
def parts_reclassified(spark, root):
    rows = Q.reclassify(_parts(spark, root))
    return rows.groupBy("property_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("retagged").alias("retagged"))


REGION_URL = "url || CASE page_id % 4 WHEN 0 THEN '/kiev/a' WHEN 1 THEN '/Lviv-kiev/a' WHEN 2 THEN '/irpin' ELSE '/x' END"


@query("pages_in_region", f"SELECT page_id FROM pages WHERE NOT {any_sql(f'lower({REGION_URL})', R.REGION_FOREIGN)} AND {any_sql(f'lower({REGION_URL})', R.REGION_LOCAL)}")
def pages_in_region(spark, root):
    k = F.col("page_id")
    tail = F.when(k % 4 == 0, "/kiev/a").when(k % 4 == 1, "/Lviv-kiev/a").when(k % 4 == 2, "/irpin").otherwise("/x")
    rows = table(spark, root, "pages").withColumn("url", F.concat("url", tail))
    return Q.keep_in_region(rows).select("page_id")


DISTRICT_CASE = "CASE c_custkey % 10 " + " ".join("WHEN {} THEN '{}'".format(i, n.replace("'", "''")) for i, (n, _) in enumerate(R.DISTRICTS)) + " END"


def _district_text(column: int):
    names = F.array(*[F.lit(pair[column]) for pair in R.DISTRICTS])
    return F.element_at(names, (F.col("c_custkey") % 10 + 1).cast("int"))


@query("districts_normalized", f"SELECT c_custkey, {DISTRICT_CASE} AS district FROM customer")
def districts_normalized(spark, root):
    raw = F.when(F.col("c_custkey") % 2 == 0, F.concat(_district_text(0), F.lit(" район"))).otherwise(F.concat(F.upper(_district_text(1)), F.lit(" р-н")))
    return table(spark, root, "customer").select("c_custkey", T.normalize_district(raw).alias("district"))


@query("districts_from_text", f"SELECT c_custkey, {DISTRICT_CASE} AS district FROM customer")
def districts_from_text(spark, root):
    rows = table(spark, root, "customer").select(
        "c_custkey", F.lit(None).cast("string").alias("district"), F.concat(F.lit("вул. "), "c_name").alias("address_raw"),
        F.concat(F.lit("Офіс, "), _district_text(0), F.lit(" район, 120 м²")).alias("title"), F.lit("Київ").alias("city"))
    return T.with_district(rows).select("c_custkey", F.col("district_norm").alias("district"))


# --- phones, finance terms, OPEX ------------------------------------------------------------------------

SUBSCRIBER = "lpad(CAST(c_custkey % 10000000 AS VARCHAR), 7, '0')"


@query("phones_extracted", f"SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '050' || {SUBSCRIBER} || ',067' || {SUBSCRIBER} WHEN 1 THEN '044' || {SUBSCRIBER} WHEN 2 THEN '' ELSE '093' || {SUBSCRIBER} END AS phones FROM customer")
def phones_extracted(spark, root):
    k = F.col("c_custkey")
    n = F.lpad((k % 10_000_000).cast("string"), 7, "0")
    dashed = F.concat(F.substring(n, 1, 3), F.lit("-"), F.substring(n, 4, 2), F.lit("-"), F.substring(n, 6, 2))
    text = (
        F.when(k % 4 == 0, F.concat(F.lit("Тел. +38 (050) "), dashed, F.lit(" або 067"), n, F.lit("; 050"), n))
        .when(k % 4 == 1, F.concat(F.lit("<a href='tel:+38044"), n, F.lit("'>"))).when(k % 4 == 2, F.concat(F.lit("12.050"), n, F.lit(" 011"), n))
        .otherwise(F.concat(F.lit("?number=%2B38093"), n))
    )
    return table(spark, root, "customer").select("c_custkey", F.array_join(T.extract_phones(text), ",").alias("phones"))


@query("finance_terms", with_(LV, body="""SELECT listing_id, CASE WHEN listing_id % 9 = 0 THEN CAST(listing_id % 12 + 1 AS DOUBLE) END AS cap_rate_pct,
  CASE WHEN listing_id % 9 = 0 THEN CAST(1000 + listing_id % 500 AS DOUBLE) END AS noi FROM lv"""))
def finance_terms(spark, root):
    return T.with_finance_terms(listing_view(spark, root), F.col("description")).select("listing_id", "cap_rate_pct", "noi")


OPEX_PHRASES = ("Аренда, без OPEX", "оренда + OPEX окремо", "Ставка с OPEX включена", "Все включено", "просто офіс", "с opex, но без opex", "netto", "не включає opex")
OPEX_CLASS = ("without", "without", "with", "with", "unknown", "unknown", "without", "unknown")


@query("opex_detected", with_(LV, body="SELECT listing_id, CASE WHEN deal_type = 'rent' AND opex IN ('with', 'without') THEN opex ELSE CASE (listing_id // 2) % 8 " + " ".join(
    f"WHEN {i} THEN '{c}'" for i, c in enumerate(OPEX_CLASS)) + " END END AS opex FROM lv"))
def opex_detected(spark, root):
    phrase = F.element_at(F.array(*[F.lit(p) for p in OPEX_PHRASES]), (F.floor(F.col("listing_id") / 2) % 8 + 1).cast("int"))
    return listing_view(spark, root).select("listing_id", T.resolve_opex(F.col("opex"), phrase, F.col("title")).alias("opex"))


# --- pages ----------------------------------------------------------------------------------------------


_SHOWN = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(h,
  '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'),
  '&nbsp;', ' '), '&quot;', '"'), '&#39;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g'))"""


@query("pages_not_blocked", "SELECT page_id FROM (SELECT *, " + " + ".join(
    f"CAST(contains(lower(h), '{m}') AS INTEGER)" for m in R.BLOCK_MARKERS) + f""" AS hits, lower({_SHOWN}) AS shown,
  1 - length(regexp_replace(shown, '{"|".join(R.BLOCK_MARKERS)}', '', 'g'))::DOUBLE / length(shown) AS share FROM
  (SELECT page_id, CASE page_id % 5 WHEN 0 THEN '<html>Just a moment</html>' WHEN 1 THEN 'captcha by Cloudflare ' || html WHEN 2 THEN 'captcha ' || html || repeat(' ', 2500) WHEN 3 THEN html || ' captcha' ELSE html END AS h FROM pages))
WHERE NOT (hits >= 2 OR hits = 1 AND (shown = '' OR share >= {R.BLOCK_SHARE}))""")
def pages_not_blocked(spark, root):
    k, html = F.col("page_id"), F.col("html")
    shown = (
        F.when(k % 5 == 0, "<html>Just a moment</html>").when(k % 5 == 1, F.concat(F.lit("captcha by Cloudflare "), html))
        .when(k % 5 == 2, F.concat(F.lit("captcha "), html, F.repeat(F.lit(" "), 2500)))
        .when(k % 5 == 3, F.concat(html, F.lit(" captcha"))).otherwise(html)
    )
    return P.drop_blocked_pages(table(spark, root, "pages").withColumn("html", shown)).select("page_id")


@query("page_anchors", """SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS href FROM pages) GROUP BY 1, 2""")
def page_anchors(spark, root):
    rows = table(spark, root, "pages").select(F.col("page_id").cast("string").alias("url"), "html")
    return P.page_anchors(rows).groupBy(F.col("page_url").cast("bigint").alias("page_id"), "href").agg(F.count(F.lit(1)).alias("n"))


@query("listing_ids_from_urls", with_(LV, body="SELECT listing_id, CASE listing_id % 3 WHEN 0 THEN 'a' || listing_id || 'Z' ELSE CAST(1000000 + listing_id AS VARCHAR) END AS found FROM lv"))
def listing_ids(spark, root):
    k = F.col("listing_id")
    big_id = (1_000_000 + k).cast("string")
    url = (
        F.when(k % 3 == 0, F.concat(F.lit("https://x.example/d/test-IDa"), k.cast("string"), F.lit("Z.html?x=1")))
        .when(k % 3 == 1, F.concat(F.lit("https://x.example/realty-kiev-"), big_id, F.lit(".html")))
        .otherwise(F.concat(F.lit("https://x.example/o/"), big_id, F.lit("/view")))
    )
    return listing_view(spark, root).select("listing_id", T.listing_id_from_url(url).alias("found"))


@query("page_statuses", """SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'sold_or_unavailable' WHEN page_id % 6 = 1 THEN 'sold'
  WHEN page_id % 6 = 2 OR regexp_matches(lower(html), '(^|[^\\p{L}\\p{N}_])(rented|leased)($|[^\\p{L}\\p{N}_])') THEN 'rented' WHEN page_id % 6 = 3 THEN 'inactive_404'
  WHEN page_id % 6 = 4 THEN 'inactive' ELSE 'active' END AS status FROM pages""")
def page_statuses(spark, root):
    def block(state):
        return f'<script type="application/ld+json">{{"@type":"Product","offers":{{"availability":"https://schema.org/{state}"}}}}</script>'

    notes = [block("SoldOut"), "<b>Об'єкт продано</b>", "<p>здано</p>", '{"statusCode": 404}', "Оголошення неактуальне", block("InStock")]
    note = F.element_at(F.array(*[F.lit(n) for n in notes]), (F.col("page_id") % 6 + 1).cast("int"))
    rows = table(spark, root, "pages").withColumn("html", F.concat("html", note))
    return rows.select("page_id", P.page_status(F.col("html"), P.json_blocks(F.col("html"))).alias("status"))


# Portal pages written from the listing view, to be read back by the extraction rules.


def _json(*fields):
    return F.to_json(F.struct(*fields))


def _page_rows(spark, root):
    k = F.col("listing_id")
    return spread(listing_view(spark, root)).withColumns({
        "pub": (1_000_000 + k).cast("string"), "lat0": F.lit(50.4) + (k % 100) / 1000, "lon0": F.lit(30.5) + (k % 100) / 1000,
    })


def _as_pages(rows, source, html, kind="list", url=None):
    return rows.select(
        F.lit(source).alias("source"), "deal_type", F.lit("kyiv").alias("zone"), F.lit(1).alias("page_no"), F.lit(kind).alias("kind"),
        (F.concat(F.lit("p/"), F.col("external_id")) if url is None else url).alias("url"), F.col("last_seen_at").alias("fetched_at"), html.alias("html"))


def _offer(*more):
    return F.struct(F.lower("currency").alias("priceCurrency"), F.col("price").alias("price"), F.lit("https://schema.org/InStock").alias("availability"), *more)


def _ld_pages(rows):
    swap = F.col("listing_id") % 2 == 0
    item = F.struct(
        F.col("title").alias("name"), F.struct(F.col("area_sqm").alias("value")).alias("floorSize"),
        F.struct(F.when(swap, F.col("lon0")).otherwise(F.col("lat0")).alias("latitude"), F.when(swap, F.col("lat0")).otherwise(F.col("lon0")).alias("longitude")).alias("geo"),
        F.struct(F.col("address_raw").alias("streetAddress"), F.lit("Київ").alias("addressLocality")).alias("address"),
        _offer(F.struct(F.col("district").alias("name")).alias("areaServed")).alias("offers"))
    block = _json(F.array(F.lit("ItemList"), F.lit("Page")).alias("@type"), F.array(F.struct(item.alias("item"))).alias("itemListElement"))
    html = F.concat(F.lit('<html><script type="application/ld+json">{bad</script><script type="application/ld+json">'), block,
                    F.lit('</script><a href="/realty/'), F.col("pub"), F.lit('">x</a></html>'))
    return _as_pages(rows, "lun", html)


@query("cards_from_json_ld", with_(LV, body="""SELECT CAST(1000000 + listing_id AS VARCHAR) AS external_id, title, price, currency, area_sqm, address_raw || ', Київ' AS address_raw, district,
  50.4::DOUBLE + (listing_id % 100) / 1000 AS lat, 30.5::DOUBLE + (listing_id % 100) / 1000 AS lon, 'active' AS source_status_raw FROM lv"""))
def cards_from_json_ld(spark, root):
    rows = P.listings_from_json_ld(_ld_pages(_page_rows(spark, root)))
    return rows.select("external_id", "title", "price", "currency", "area_sqm", "address_raw", "district", "lat", "lon", "source_status_raw")


@query("json_ld_blocks", with_(LV, body="SELECT external_id, 'itemlist' AS kind FROM lv"))
def json_ld_blocks(spark, root):
    blocks = P.json_ld_of_type(P.extract_json_ld(_ld_pages(_page_rows(spark, root))), "itemList")
    return blocks.select(F.regexp_extract("url", "^..(.*)$", 1).alias("external_id"), F.element_at(P.block_types(F.col("block")), 1).alias("kind"))


@query("offer_fields", with_(LV, body="""SELECT external_id, price, currency, 50.4::DOUBLE + (listing_id % 100) / 1000 AS lat, 30.5::DOUBLE + (listing_id % 100) / 1000 AS lon, address_raw || ', Київ' AS address FROM lv"""))
def offer_fields(spark, root):
    blocks = P.extract_json_ld(_ld_pages(_page_rows(spark, root)))
    items = blocks.withColumn("block", P.get(F.col("block"), "$.itemListElement[0].item", "variant"))
    return P.offer_fields(items).select(F.regexp_extract("url", "^..(.*)$", 1).alias("external_id"), "price", "currency", "lat", "lon", "address")


def _state_pages(rows):
    param = lambda key, value: F.struct(F.lit(key).alias("key"), value.cast("string").alias("normalizedValue"))
    ad = F.struct(
        F.col("listing_id").alias("id"), F.col("title").alias("title"), F.concat(F.lit("/d/"), "external_id", F.lit(".html?x")).alias("url"),
        F.array(param("total_area", F.col("area_sqm")), param("floor", F.col("floor"))).alias("params"),
        F.struct(F.struct(F.col("price").alias("value"), F.col("currency").alias("currencyCode")).alias("regularPrice")).alias("price"),
        F.struct(F.lit("Київ").alias("cityName"), F.col("district").alias("districtName")).alias("location"),
        F.struct(F.col("agency").alias("name")).alias("user"))
    state = _json(F.struct(F.struct(F.array(ad).alias("ads")).alias("listing")).alias("listing"))
    escaped = F.replace(F.replace(state, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return _as_pages(rows, "olx", F.concat(F.lit('<script>window.__PRERENDERED_STATE__="'), escaped, F.lit('";</script>')))


@query("cards_from_state_json", with_(LV, body="""SELECT external_id, title, 'https://www.olx.ua/d/' || external_id || '.html' AS url, price, currency, area_sqm, floor,
  CASE WHEN district IS NULL THEN 'Київ' ELSE district || ', Київ' END AS address_raw, agency AS seller FROM lv"""))
def cards_from_state(spark, root):
    rows = P.listings_from_state_json(_state_pages(_page_rows(spark, root)))
    return rows.select("external_id", "title", "url", "price", "currency", "area_sqm", "floor", "address_raw", F.col("extra.seller").alias("seller"))


def _card_pages(rows):
    whole = F.rint("price").cast("bigint").cast("string")
    html = F.concat(
        F.lit('<div><div class="catalog-card wide" data-catalog-item-id="'), F.col("pub"), F.lit('"><a href="/commercials-sale/view/'), F.col("pub"),
        F.lit('/?p=1">x</a><b class="catalog-card-price-title">'), F.coalesce(F.concat(whole, F.lit(" $")), F.lit("")), F.lit('</b><div class="catalog-card-address">'), F.col("address_raw"),
        F.lit('</div><p class="catalog-card-description">'), F.coalesce(F.concat(F.col("area_sqm").cast("int").cast("string"), F.lit(" м², ")), F.lit("")), (F.col("floor") + 1).cast("string"),
        F.lit(" поверх</p></div></div>"))
    return _as_pages(rows, "rieltor", html)


@query("cards_from_catalog", with_(LV, body="""SELECT CAST(1000000 + listing_id AS VARCHAR) AS external_id, 'https://rieltor.ua/commercials-sale/view/' || (1000000 + listing_id) || '/' AS url,
  CAST(CAST(price AS BIGINT) AS DOUBLE) AS price, area_sqm, floor + 1 AS floor, address_raw FROM lv"""))
def cards_from_catalog(spark, root):
    rows = P.listings_from_cards(_card_pages(_page_rows(spark, root)))
    return rows.select("external_id", "url", "price", "area_sqm", "floor", "address_raw")


def _link_pages(rows):
    one = F.concat(F.lit('<a href="/uk/realty-prodaja-'), F.when(F.col("listing_id") % 4 == 0, "lviv").otherwise("kiev"), F.lit("-"), F.col("pub"), F.lit('.html?u=1">'))
    text = F.concat(F.lit("Офіс вул. Лугова "), (F.col("listing_id") % 90 + 1).cast("string"), F.lit(", 120 м², "), (F.col("listing_id") + 50_000).cast("string"), F.lit(" $"))
    return _as_pages(rows, "domria", F.concat(F.lit("<p>"), one, text, F.lit("</a><p>"), one, F.lit("Дублікат картки</a>")))


@query("cards_from_links", with_(LV, body="""SELECT CAST(1000000 + listing_id AS VARCHAR) AS external_id, CAST(listing_id + 50000 AS DOUBLE) AS price, 120.0::DOUBLE AS area_sqm,
  'вул. Лугова ' || (listing_id % 90 + 1) AS address_raw FROM lv WHERE listing_id % 4 <> 0"""))
def cards_from_links(spark, root):
    rows = P.listings_from_anchors(_link_pages(_page_rows(spark, root)), P.LINK_RULES["domria"])
    return rows.select("external_id", "price", "area_sqm", "address_raw")


@query("cards_of_all_portals", with_(LV, body="""SELECT source, count(*) AS n, count(price) AS priced FROM (SELECT 'lun' AS source, price FROM lv UNION ALL SELECT 'olx', price FROM lv
UNION ALL SELECT 'rieltor', price FROM lv UNION ALL SELECT 'domria', 1.0 FROM lv WHERE listing_id % 4 <> 0) GROUP BY 1"""))
def cards_of_all_portals(spark, root):
    rows = _page_rows(spark, root)
    pages = _ld_pages(rows).unionByName(_state_pages(rows)).unionByName(_card_pages(rows)).unionByName(_link_pages(rows))
    return P.observations_from_pages(pages).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("price").alias("priced"))


def _detail_pages(rows):
    product = F.struct(
        F.lit("Product").alias("@type"), F.concat(F.lit("Офіс "), "title").alias("name"), F.concat(F.lit("Площа 77 м², "), (F.col("floor") + 1).cast("string"), F.lit(" поверх")).alias("description"),
        _offer(F.struct(F.col("agency").alias("name")).alias("seller"), F.lit("Обл., район Дарницкий, вулиця").alias("areaServed")).alias("offers"))
    n = F.lpad((F.col("property_id") % 10_000_000).cast("string"), 7, "0")
    html = F.concat(F.lit('<html><meta property="og:title" content="Заголовок"><script type="application/ld+json">'), F.to_json(F.array(product)),
                    F.lit("</script><body>Тел. 050"), n, F.lit("</body></html>"))
    return _as_pages(rows, "domria", html, "detail", F.col("url"))


@query("details_merged", with_(LV, body="""SELECT external_id, 'Офіс ' || title AS title, price, CASE WHEN price IS NULL THEN 'GBP' ELSE currency END AS currency, CASE WHEN listing_id % 2 = 0 THEN 77.0 ELSE 55.0 END AS area_sqm, floor + 1 AS floor, coalesce(agency, 'listed') AS agency,
  '050' || lpad(CAST(property_id % 10000000 AS VARCHAR), 7, '0') AS phone, 'Дарницкий' AS district, 'office' AS property_type, 'active' AS status FROM lv"""))
def details_merged(spark, root):
    rows = _page_rows(spark, root)
    cards = conform(rows.select(
        F.lit("domria").alias("source"), "external_id", "url", "deal_type", F.lit("card").alias("title"), F.lit("GBP").alias("currency"),
        F.when(F.col("listing_id") % 2 == 1, 55.0).alias("area_sqm"), F.lit("listed").alias("agency")), "observations")
    merged = P.merge_details(cards, P.detail_fields(_detail_pages(rows)))
    return merged.select("external_id", "title", "price", "currency", "area_sqm", "floor", "agency", "phone", "district", "property_type", F.col("source_status_raw").alias("status"))


@query("page_meta_titles", with_(LV, body="SELECT external_id, 'Заголовок' AS og_title FROM lv"))
def page_meta(spark, root):
    rows = _page_rows(spark, root)
    pages = _detail_pages(rows).withColumn("key", F.regexp_extract("url", r"(\d+)$", 1))
    return P.with_meta(pages, "og:title").select(F.col("key").alias("external_id"), "og_title")
