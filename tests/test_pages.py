"""Page extraction on own pages: several cards, lists and fetches per page, with headers and footers."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lotlens.schemas import TABLES
from lotlens.sources import pages as P


def ld(*blocks):
    return "".join(f"<script type='application/ld+json'>{b if isinstance(b, str) else json.dumps(b, ensure_ascii=False)}</script>" for b in blocks)


def element(name, price=None, currency="UAH", **more):
    offer = {"price": price, "priceCurrency": currency} if price is not None else None
    return {"position": 1, "item": {"name": name, **({"offers": offer} if offer else {}), **more}}


LONG_NAME = "Склад, провулок Кар'єрний " + "довгий опис " * 60
TWO_LISTS = ld(
    {"@type": "ItemList", "itemListElement": [
        element("Магазин, вулиця Липова 12", 41_000, floorSize={"value": "64.5"}, address={"addressLocality": "Ірпінь", "streetAddress": "Липова 12"}),
        element("Кафе, вулиця Озерна 7", "99500", "usd")]},
    "not json at all",
    {"@type": "BreadcrumbList", "itemListElement": [{"name": "Головна"}]},
    {"@type": ["Thing", "ItemList"], "itemListElement": [element(LONG_NAME, 7_300)]},
) + "<nav><a href='/realty/800100'>1</a><a href='/realty/800200'>2</a><a href='/realty/800100'>1</a></nav><footer>044 200-00-00</footer>"


def ad(number, **more):
    return {"id": number, "title": f"Торгове приміщення номер {number}", "url": f"/d/obj-{number}.html?from=list", "params": [],
            "price": {"regularPrice": {"value": 1_000 * number, "currencyCode": "usd"}}, "location": {"cityName": "Бровари"}, "status": "active", **more}


def embedded(*ads):
    text = json.dumps({"listing": {"listing": {"ads": ads}}}, ensure_ascii=False)
    return f"<body><script>window.__PRERENDERED_STATE__={json.dumps(text, ensure_ascii=False)};</script><p>після</p></body>"


ADS = embedded(
    ad(61, description="слово " * 1200, params=[{"key": "floor", "normalizedValue": "4"}, {"key": "total_area", "normalizedValue": "38"}]),
    ad(62, user={"name": "Оксана"}), {"id": 63, "title": "мало", "url": "/d/z.html"}, {"id": 64, "title": "Без посилання зовсім"})


def catalog_card(number, inside):
    return f"<div data-catalog-item-id='{number}' class='wide catalog-card'><a href='/commercials-rent/view/{number}/'>далі</a>{inside}</div>"


CATALOG = "<header>Пошук 5 м²</header><main>" + catalog_card(
    301, "<p class='catalog-card-price-title'>18 400 грн</p><span class='catalog-card-address'>бульвар Кленовий, 9</span><div class='catalog-card-description'>салон 46 м², 1 поверх, тел. 067 300-40-50</div>",
) + catalog_card(302, "<p class='catalog-card-price-title'>730 $</p><div class='catalog-card-address'><div>узвіз Тихий</div>, <b>2</b></div>") + "<div class='catalog-card'>без номера</div></main>" + (
    "<footer>Редакція: площа 812 м², 11 поверх, тел. 044 555-66-77, Печерський р-н</footer>")

ANCHORS = "".join(f"<li><a href='{href}'>{text}</a></li>" for href, text in (
    ("/uk/realty-orenda-kyiv-ofis-5550001.html?page=3", "Оренда складу вул. Зоряна 14, 310 м² 62 000 грн"),
    ("/uk/realty-orenda-kyiv-ofis-5550001.html", "ще раз те саме"), ("/uk/realty-orenda-odesa-ofis-5550002.html", "Одеса, інше місто"),
    ("/help", "Допомога"), ("/uk/realty-orenda-kyiv-ofis-5550003.html", "Оренда кабінету вул. Тиха 1, 15 м² 9 000 грн")))

PRODUCT = "<meta content='Кабінет лікаря' property='og:title'>" + ld([
    {"@type": "Product", "name": "Кабінет лікаря, поверх - 5", "offers": {"price": 880, "priceCurrency": "USD", "seller": {"name": "Марта"}, "itemOffered": "кабінет 27 м²", "availability": "InStock"}},
    {"@type": "LocalBusiness", "geo": {"latitude": 50.31, "longitude": 30.52}}]) + "<p>дзвоніть +380673004050</p>"
CRUMBS = "<meta property='og:description' content='Приміщення 142 м2, поверх 3'>" + ld(
    {"@type": "BreadcrumbList", "itemListElement": [{"name": "Україна"}, {"item": {"name": "Подільський"}}]}) + "<a href='tel:+380501234500'>тел</a>"
BARE = "<meta property='og:title' content='Здам зал 80 м²'><p>без опису</p>"
GONE = "<h1>Оголошення видалено</h1>"
FENCE = "<title>x</title><h1>Attention required</h1>"
ARTICLE = "<article>" + "звичайний текст сторінки " * 500 + "captcha</article>"


def page(number, source, deal, kind, url, html):
    return source, deal, "kyiv", 1, kind, url, dt.datetime(2024, 3, 1, number), html


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        page(1, "lun", "rent", "list", "http://a/lun", TWO_LISTS), page(1, "olx", "sale", "list", "http://a/olx", ADS),
        page(1, "rieltor", "rent", "list", "http://a/rieltor", CATALOG), page(1, "domria", "rent", "list", "http://a/domria", ANCHORS),
        page(1, "domria", "rent", "detail", "http://d/domria", GONE), page(2, "domria", "rent", "detail", "http://d/domria", PRODUCT),
        page(1, "lun", "rent", "detail", "http://d/lun", CRUMBS), page(1, "rieltor", "rent", "detail", "http://d/rieltor", BARE),
        page(1, "lun", "rent", "detail", "http://d/gone", GONE), page(1, "lun", "rent", "list", "http://a/fence", FENCE),
        page(1, "lun", "rent", "list", "http://a/article", ARTICLE),
    ]
    names = [c.name for c in spark.createDataFrame([], TABLES["pages"]).schema]
    order = ["source", "deal_type", "zone", "page", "kind", "url", "fetched_at", "html"]
    return spark.createDataFrame([tuple(dict(zip(order, r, strict=True)).get(n, r[3]) for n in names) for r in rows], TABLES["pages"])


def at(pages, url):
    return pages.where(F.col("url") == url)


def test_fences_by_share_of_text(pages):
    kept = {r.url for r in P.drop_blocked_pages(pages).collect()}
    assert "http://a/fence" not in kept and "http://a/article" in kept and len(kept) == 9


def test_all_lists_of_a_page(pages):
    first, second, third = P.listings_from_json_ld(at(pages, "http://a/lun")).orderBy("position").collect()
    assert (first.external_id, first.price, first.currency, first.area_sqm, first.city) == ("800100", 41_000.0, "UAH", 64.5, "Ірпінь")
    assert (second.external_id, second.price, second.currency) == ("800200", 99_500.0, "USD")
    assert third.title == LONG_NAME and third.price == 7_300.0 and third.extra.skip_detail


def test_blocks_by_type(pages):
    blocks = P.extract_json_ld(at(pages, "http://a/lun"))
    assert (blocks.count(), P.json_ld_of_type(blocks, "itemlist").count()) == (3, 2)


def test_ads_of_the_page_state(pages):
    one, two = P.listings_from_state_json(at(pages, "http://a/olx")).orderBy("external_id").collect()
    assert (one.external_id, one.price, one.currency, one.floor, one.area_sqm) == ("61", 61_000.0, "USD", 4, 38.0)
    assert len(one.description.strip()) > 7_000 and one.url == "https://www.olx.ua/d/obj-61.html" and one.city == "Бровари"
    assert two.extra.seller == "Оксана" and two.area_sqm is None


def test_cards_of_a_catalog(pages):
    one, two = P.listings_from_cards(at(pages, "http://a/rieltor")).orderBy("external_id").collect()
    assert (one.external_id, one.price, one.currency, one.area_sqm, one.floor, one.phone) == ("301", 18_400.0, "UAH", 46.0, 1, "0673004050")
    assert (two.external_id, two.price, two.currency, two.phone) == ("302", 730.0, "USD", None)
    assert two.address_raw.replace(" ,", ",") == "узвіз Тихий, 2"
    assert (two.area_sqm, two.floor, two.district) == (None, None, None)


def test_first_element(spark):
    cases = {
        "<div a='1'>x<div>y</div>z</div> tail <div>": "<div a='1'>x<div>y</div>z", "<P>a<b>c</b></p>d": "<P>a<b>c</b>",
        "<div>open <div>never</div>": None, "<span></span>": "<span>", "": None, None: None,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t STRING").select("t", P.first_element(F.col("t")).alias("e")).collect()
    assert {r.t: r.e for r in rows} == cases


def test_links_of_a_list(pages):
    one, two = P.listings_from_anchors(at(pages, "http://a/domria"), P.LINK_RULES["domria"]).orderBy("external_id").collect()
    assert (one.external_id, one.price, one.currency, one.area_sqm, one.address_raw) == ("5550001", 62_000.0, "UAH", 310.0, "вул. Зоряна 14")
    assert (two.external_id, two.area_sqm) == ("5550003", 15.0)


def test_latest_fetch_of_a_detail(pages):
    cards = P.observations_from_pages(pages)
    card = cards.where("external_id = '800200'").drop("page_url", "position").withColumns({
        "area_sqm": F.lit(None).cast("double"), "description": F.lit("зі списку"), "lat": F.lit(None).cast("double")})
    details = P.detail_fields(pages.where("kind = 'detail'"))
    assert details.count() == 4

    def merged(source, url):
        (row,) = P.merge_details(card.withColumns({"source": F.lit(source), "url": F.lit(url)}), details).collect()
        return row

    ria = merged("domria", "http://d/domria")
    assert (ria.price, ria.currency, ria.agency, ria.area_sqm, ria.floor) == (880.0, "USD", "Марта", 27.0, 5)
    assert (ria.lat, ria.lon, ria.phone, ria.source_status_raw) == (50.31, 30.52, "0673004050", "active")
    lun = merged("lun", "http://d/lun")
    assert (lun.area_sqm, lun.floor, lun.district, lun.phone) == (142.0, 3, "Подільський", "0501234500")
    rieltor = merged("rieltor", "http://d/rieltor")
    assert (rieltor.description, rieltor.area_sqm) == ("зі списку", 80.0)
    assert merged("lun", "http://d/none").description == "зі списку"


def test_status_of_a_page(pages):
    row = at(pages, "http://d/gone").select(P.page_status(F.col("html"), P.json_blocks(F.col("html"))).alias("s")).first()
    assert row.s == "inactive"


def test_all_portals_at_once(pages):
    got = {r["source"]: r["count"] for r in P.observations_from_pages(pages).groupBy("source").count().collect()}
    assert got == {"lun": 3, "olx": 2, "rieltor": 2, "domria": 2}
