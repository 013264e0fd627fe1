"""Golden rows of the text, price and classification rules."""

import pytest
from pyspark.sql import functions as F

from lotlens.functions import identity as I
from lotlens.functions import money as Y
from lotlens.functions import text as T
from lotlens.functions.segments import classify_segment

NONE = None
TEXTS = {
    "Оренда офісу 2 500 $ / міс": (2500.0, "USD", NONE),
    "3 181 860 $ 495 $/м² Куренівський пров.": (3181860.0, "USD", 495.0),
    "21 095 $/міс 22 $/м² Миколи Грінченка": (21095.0, "USD", 22.0),
    "17 17 250 000 $ 2 790 $/м² 90 м² Фортечний тупик": (250000.0, "USD", 2790.0),
    "250 000 $ 1 645 $/м² Київ 152 м² 11 207 750грн": (250000.0, "USD", 1645.0),
    "185 000 $": (185000.0, "USD", NONE),
    "$2500000": (2500000.0, "USD", NONE),
    "без ціни": (NONE, NONE, NONE),
    "40 $/sqm": (NONE, "USD", 40.0),
}
OWN_TEXTS = {
    "250 000 $ 10 500 000 грн": (250000.0, "USD", NONE),
    "10 500 000 грн 250 000 $": (250000.0, "USD", NONE),
    "Магазин 3 120 500 $ 0671112233": (3120500.0, "USD", NONE),
    "17 17 250 000 $ Фортечний тупик": (250000.0, "USD", NONE),
    "17 17 250 500 $ Фортечний тупик": (250500.0, "USD", NONE),
    "поверх 3 1 250 000 $": (1250000.0, "USD", NONE),
    "поверх 5 $ 250000": (5.0, "USD", NONE),
    "поверх 5 $250000": (250000.0, "USD", NONE),
    "80 000 € / 93 000 $ / 3 900 000 грн": (93000.0, "USD", NONE),
    "ціна: 45 000 грн, торг": (45000.0, "UAH", NONE),
    "8 95 000 €": (95000.0, "EUR", NONE),
}


def test_price_text(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t STRING")
    rows = Y.with_total_price(Y.with_rate(df, F.col("t")), F.col("t")).collect()
    assert {r.t: (r.text_total, r.text_currency, r.text_rate) for r in rows} == TEXTS


def test_price_text_with_several_numbers(spark):
    df = spark.createDataFrame([(t,) for t in OWN_TEXTS], "t STRING")
    rows = Y.with_total_price(Y.with_rate(df, F.col("t")), F.col("t")).collect()
    assert {r.t: (r.text_total, r.text_currency, r.text_rate) for r in rows} == OWN_TEXTS


def test_digit_soup(spark):
    soup = "вул. Тестова 1 " + " ".join(str(i) for i in range(100000, 100050)) + " грн"
    row = Y.with_total_price(spark.createDataFrame([(soup,)], "t STRING"), F.col("t")).first()
    assert row.text_total is None or row.text_total < 1e9


NORM = [
    (17250000.0, "USD", 90.0, "sale", 2790.0, "17 17 250 000 $ 2 790 $/м² Фортечний тупик 90 м²", 251100.0, 2790.0, False, False),
    (22120000.0, "USD", 60.0, "sale", 368666.0, "22 22 120 000 $ 2 000 $/м² вул. Тестова", 120000.0, 2000.0, False, False),
    (15.0, "USD", 467.0, "rent", None, "7 005 $/міс 15 $/м² Нижньоключова", 7005.0, 15.0, False, False),
    (15.0, "USD", 467.0, "rent", None, "Оренда 15 $/м²", 7005.0, 15.0, True, False),
    (31196.0, "USD", 2166.0, "rent", None, "31 196 $/міс 14 $/м² Гетьмана", 31196.0, 14.0, False, False),
    (2500.0, "USD", 100.0, "rent", None, "Офіс 2500$", 2500.0, 25.0, False, False),
    (1800.0, "USD", 120.0, "sale", None, "Продаж офісу", 216000.0, 1800.0, True, False),
    (2500000.0, "USD", 100.0, "sale", None, "Офіс 2.5 млн", 2500000.0, 25000.0, False, True),
    (30000.0, "USD", 200.0, "sale", None, "Офис 30000$", 30000.0, 150.0, False, True),
    (781.0, "USD", 140.0, "rent", 781.0, None, 781.0, 5.5786, False, False),
]


def test_price_normalisation(spark):
    df = spark.createDataFrame(
        [(i, *r[:6], None) for i, r in enumerate(NORM)],
        "i INT, price DOUBLE, currency STRING, area_sqm DOUBLE, deal_type STRING, price_per_sqm DOUBLE, title STRING, description STRING")
    rows = {r.i: r.price_norm for r in Y.normalize_price(df).collect()}
    for i, r in enumerate(NORM):
        got = rows[i]
        assert (got.price, got.price_per_sqm, got.reinterpreted, got.suspicious) == r[6:], r


def test_rent_currency_and_effective_rate(spark):
    df = spark.createDataFrame(
        [(559260.0, "USD", 286.0, "rent", None), (781.0, "USD", 140.0, "rent", 781.0)],
        "price DOUBLE, currency STRING, area_sqm DOUBLE, deal_type STRING, price_per_sqm DOUBLE")
    c = F.col
    rows = Y.with_effective_rate(df).withColumn("cur", Y.fix_rent_currency(c("price"), c("currency"), c("area_sqm"), c("deal_type"))).collect()
    assert rows[0].cur == "UAH" and rows[1].cur == "USD"
    assert rows[1].rate_usd == pytest.approx(5.58, rel=0.01)


def test_currency(spark):
    row = spark.range(1).select(
        Y.to_usd(F.lit(4461.0), F.lit("uah")).alias("a"), Y.to_usd(F.lit(100.0), F.lit("EUR")).alias("b"),
        Y.to_usd(F.lit(1.0), F.lit("PLN")).alias("c"), Y.to_usd(F.lit(7.0), F.lit(None).cast("string")).alias("d")).first()
    assert row.a == pytest.approx(100) and row.b == pytest.approx(116.9) and row.c is None and row.d == 7.0


SEGMENTS = [
    ("Оренда складу 600 м² логістика", "warehouse", None, False, "excluded"),
    ("Виробничий цех / промисловий комплекс", None, None, False, "excluded"),
    ("Офіс 120 м² Шевченківський", None, 4, True, "office"),
    ("Шоурум на Печерську 80 м²", None, None, True, "showroom"),
    ("Оренда в БЦ Gulliver", None, None, True, "business_center"),
    ("Торгове приміщення вільного призначення", None, 1, True, "street_retail"),
    ("Окрема будівля під бізнес 450 м²", None, None, True, "building"),
    ("Приміщення у місто, простора стоянка", None, None, True, "other"),
    ("СТО на три пости", None, None, False, "excluded"),
    ("Лугова 5", "showroom", None, True, "free_purpose"),
    ("а", None, None, False, "excluded"),
]


def test_segments(spark):
    rows = [(i, t, p, f) for i, (t, p, f, _, _) in enumerate(SEGMENTS)]
    df = spark.createDataFrame(rows, "i INT, title STRING, property_type STRING, floor INT").withColumns(
        {c: F.lit(None).cast("string") for c in ("description", "address_raw", "url")})
    got = {r.i: (r.segment_decision.relevant, r.segment_decision.segment) for r in classify_segment(df).collect()}
    assert got == {i: s[3:] for i, s in enumerate(SEGMENTS)}


def test_signals(spark):
    cases = {
        "Аренда офиса, без OPEX": "without", "Оренда, + OPEX окремо": "without", "Ставка с OPEX включена": "with",
        "Все включено, all inclusive": "with", "Просто офис 100 м2": "unknown", "с opex но без opex": "unknown",
    }
    df = spark.createDataFrame([(t,) for t in cases], "t STRING")
    assert {r.t: r.o for r in df.select("t", T.detect_opex(F.col("t")).alias("o")).collect()} == cases
    row = spark.createDataFrame([("Офіс, cap rate 8.5%, NOI 120 000 USD на рік",)], "t STRING").select(
        T.cap_rate(F.col("t")).alias("c"), T.net_operating_income(F.col("t")).alias("n")).first()
    assert (row.c, row.n) == (8.5, 120000.0)


def test_sellers(spark):
    rows = [("АН Київ", "380501112233", None, 1), (None, "380501112233", None, 5), (None, "380501112233", "Офіс власника", 1), (None, None, "офіс", 1)]
    df = spark.createDataFrame(rows, "agency STRING, phone STRING, title STRING, n INT")
    c = F.col
    got = [r.s for r in df.select(T.classify_seller(c("agency"), c("phone"), c("title"), F.lit(None).cast("string"), c("n")).alias("s")).collect()]
    assert got == ["agency", "agency", "owner", "unknown"]


def test_districts_and_region(spark):
    cases = {"Дарницький район": "Дарницький", "шевченковский": "Шевченківський", "Печерському": "Печерський", "а": None, "": None}
    df = spark.createDataFrame([(t,) for t in cases], "t STRING")
    assert {r.t: r.d for r in df.select("t", T.normalize_district(F.col("t")).alias("d")).collect()} == cases
    urls = [("https://x/realty-arenda-kiev-darnitskiy-1.html", True), ("https://x/realty-lvov-bodnarovka-1.html", False), ("https://x/a", False)]
    df = spark.createDataFrame(urls, "u STRING, ok BOOLEAN")
    assert df.where(T.in_region(F.col("u")) != F.col("ok")).count() == 0


def test_fingerprints(spark):
    schema = "address_raw STRING, area_sqm DOUBLE, floor INT, price DOUBLE, property_type STRING, deal_type STRING, lat DOUBLE, lon DOUBLE, phone STRING"
    rows = [
        ("вул. Богдана Хмельницького, 16", 120.0, 4, 2200.0, "office", "rent", None, None, None),
        ("вул Богдана Хмельницького 16", 120.4, 4, 2280.0, "office", "rent", None, None, None),
        ("вул. Лугова, 1", 50.0, 1, 100000.0, "office", "sale", 50.1, 30.1, "0501112233"),
        ("вул. Лугова, 1", 50.0, 1, 102000.0, "office", "sale", 50.1, 30.1, None),
        (None, None, 1, 1000.0, "office", "rent", None, None, "0501112233"),
        (None, None, 1, 1000.0, "office", "rent", None, None, "0501112234"),
    ]
    f = [r.fingerprint for r in I.with_fingerprint(spark.createDataFrame(rows, schema)).collect()]
    assert f[0] == f[1] and f[2] == f[3] and f[4] != f[5]
    a, b, c = spark.createDataFrame([(100000.0,), (102000.0,), (120000.0,)], "p DOUBLE").select(
        I.price_band(F.col("p"), F.lit("sale")).alias("b")).collect()
    assert a.b == b.b != c.b


def test_nfkc_and_quotes(spark):
    row = spark.createDataFrame([("  Ｏｆｆｉｃｅ　№１  b`r ",)], "t STRING").select(T.normalize_text(F.col("t")).alias("x")).first()
    assert row.x == "office no1 b'r"


def test_numbers(spark):
    cases = {"1 234,5": 1234.5, "1.234.567": 1234567.0, "12.50": 12.5, "1234.567": 1234.567, "x": None, "0": None, "1,500": 1500.0}
    df = spark.createDataFrame([(t,) for t in cases], "t STRING")
    assert {r.t: r.n for r in df.select("t", T.to_number(F.col("t")).alias("n")).collect()} == cases
