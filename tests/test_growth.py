"""Steps that must stay small as the input grows: anchors of texts, calls of the ordered stream, files of a part, scans of a text, tasks of text work."""

import glob
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lotlens import session
from lotlens.functions import money
from lotlens.operators import search
from lotlens.session import scratch
from lotlens.sources import pages
from lotlens.sources.versions import VersionedTables
from lotlens.streaming import changes as K


def test_anchors_use_the_longest_runs(spark):
    fields = "NULL AS address_raw, NULL AS district, NULL AS city"
    rows = spark.sql(f"SELECT 'Lot Customer#' || lpad(id, 9, '0') || IF(id % 2 = 0, repeat(' é', 150), '') AS title, {fields} FROM range(300)")
    needles = spark.sql("SELECT 'customer#' || lpad(id, 9, '0') AS needle FROM range(50) UNION ALL SELECT 't cus' UNION ALL SELECT repeat('é ', 20)")
    found = {r.needle: r.anchor for r in search.text_anchors(needles, rows, [3, 12, 24]).collect()}
    assert len(found) == 52 and all(anchor in needle for needle, anchor in found.items())
    assert {len(a) for n, a in found.items() if n.startswith("customer")} == {12} and len(found["t cus"]) == 3 and len(found["é " * 20]) == 24
    for size in search.GRAMS:
        for text in ("", "ab", "Київ вул. Лугова 17, офіс 😀 120 м²" * 3, "x" * 500):
            cut = spark.createDataFrame([(text,)], "t string").select(
                search._grams(F.col("t"), size).alias("a"), F.when(F.length("t") >= size, search._long_grams(F.col("t"), size)).alias("b")).first()
            want = [text[i : i + size] for i in range(len(text) - size + 1)] or None
            assert cut.a == cut.b == want


class _Value:
    def __init__(self):
        self.row = None

    def exists(self):
        return self.row is not None

    def get(self):
        return self.row

    def update(self, row):
        self.row = row

    def clear(self):
        self.row = None


class _Handle(dict):
    """State in memory that counts its calls."""

    def __init__(self):
        super().__init__()
        self.timers, self.set, self.writes, self.largest = set(), 0, 0, 0

    def getValueState(self, name, schema):
        return _Value()

    def getMapState(self, name, *schemas):
        return self

    def containsKey(self, key):
        return key in self

    def getValue(self, key):
        return self[key]

    def updateValue(self, key, value):
        self.writes, self.largest = self.writes + 1, max(self.largest, len(value[0]) if key[0] > 1 else 0)
        self[key] = value

    def removeKey(self, key):
        del self[key]

    def registerTimer(self, at):
        self.set += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.remove(at)


class _Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms

    getExpiryTimeInMs = getCurrentWatermarkInMs


def _ordered(batches):
    """Events of one listing whose cards come in batches, and its state."""
    handle, out = _Handle(), []
    detector = K._OrderedDetector(72, 60)
    detector.init(handle)
    newest = 0
    for cards in [*batches, None]:
        if cards is None:
            newest += 10**9
        else:
            frame = pd.DataFrame(cards, columns=["at", "seq", "price"])
            frame["seen_at"] = pd.to_datetime(frame["at"], unit="s")
            frame["source_status_raw"] = None
            list(detector.handleInputRows(("s", "1"), iter([frame]), None))
            newest = max(newest, frame["at"].max() - 86_400)
        while handle.timers and min(handle.timers) <= newest * 1000:
            at = min(handle.timers)
            handle.timers.remove(at)
            now = _Now(newest * 1000)
            out += [tuple(r) for f in detector.handleExpiredTimer(("s", "1"), now, now) for r in f.itertuples(index=False)]
    return [(r[2], r[3], *r[4:6]) for r in out], handle


@pytest.mark.parametrize("count", [300, 5_000])
def test_ordered_stream_calls_its_state_seldom(count):
    start, rng = 1_700_000_000, random.Random(count)
    cards = [(start + i * 90, i, float(i // 3 % 7)) for i in range(count)]
    mixed = [cards[i : i + count // 2] for i in range(0, count, count // 2)]
    for part in mixed:
        rng.shuffle(part)
    got, handle = _ordered(mixed)
    whole, _ = _ordered([cards])
    assert str(got) == str(whole) and got[0][0] == "appeared" and got[-1][0] == "vanished"
    assert sum(e[0] == "price_changed" for e in got) == (count - 1) // 3
    assert not handle and handle.largest <= K.HELD_ROWS
    assert handle.set < 10 and (count > K.HELD_ROWS or handle.writes < 10)  # one timer and one entry, not one per span


def test_ordered_stream_compares_the_listings_of_a_bucket_together():
    """Many listings under one key: the events of a walk card by card for each, in few calls to the state."""
    rng, start = random.Random(3), 1_700_000_000
    raws = [None, "", "active", "sold out", "inactive", "Rented", "404", "new"]
    cards = [
        (rng.choice(["s", None]), str(rng.randrange(150)), pd.Timestamp(start + rng.randrange(20) * 50_000 + rng.randrange(90), unit="s"), n,
         rng.choice([None, 1.0, 2.0, 3.0]), rng.choice(raws)) for n in range(3000)]
    columns = ["source", "external_id", "seen_at", "seq", "price", "source_status_raw"]
    want, walker = [], K._ChangeDetector(72)
    for name in {c[:2] for c in cards}:
        state = (None, None, None, None)
        for _, _, seen, _, price, raw in sorted((c for c in cards if c[:2] == name), key=lambda c: c[2:4]):
            state = walker._step(name, state, seen, price, raw or None, want)
        if K._status(state[1]) == "active":
            want.append((*name, "vanished", state[2] + walker.idle, None, None, None, None))
    plain = lambda rows: sorted(str([None if pd.isna(v) else v for v in r]) for r in rows)
    cards.sort(key=lambda c: c[2].timestamp() + rng.randrange(200_000))
    for size, arrow in ((3000, 3000), (500, 70)):
        handle, got = _Handle(), []
        detector = K._OrderedDetector(72, 60)
        detector.init(handle)
        mark = 0
        for at in [*range(0, len(cards), size), None]:
            part = [] if at is None else cards[at : at + size]
            if part:
                frames = [pd.DataFrame(part[i : i + arrow], columns=columns) for i in range(0, len(part), arrow)]
                list(detector.handleInputRows((7,), iter(frames), None))
                mark = max(mark, int(max(c[2] for c in part).timestamp()) - 250_000)
            else:
                mark += 10**9
            while handle.timers and min(handle.timers) <= mark * 1000:
                handle.timers.remove(min(handle.timers))
                now = _Now(mark * 1000)
                got += [tuple(r) for f in detector.handleExpiredTimer((7,), now, now) for r in f.itertuples(index=False)]
        assert plain(got) == plain(want) and not handle
        assert size < 3000 or (handle.writes < 10 and handle.set < 10)


def test_a_large_part_is_written_by_several_tasks(spark):
    rows = spark.range(0, 4000, 1, 8).selectExpr("'s' AS source", "CAST(id AS STRING) AS external_id", "repeat(uuid(), 5) AS title")
    root = scratch(spark, "large-part")
    tables = VersionedTables(spark, root, {"listings": ["source", "external_id"]}, parts=2)
    frame = rows
    for name in tables.columns("listings"):
        if name not in frame.columns:
            frame = frame.withColumn(name, F.lit(None).cast(next(f.dataType for f in tables._schema("listings") if f.name == name)))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "50KB")
    try:
        tables.commit(0, {"listings": (frame, range(2))})
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert all(len(glob.glob(f"{root}/listings/version=0/part={p}/*.parquet")) > 1 for p in range(2))
    assert tables.read("listings").count() == 4000


def test_prices_of_all_currencies_in_one_scan(spark):
    texts = {
        "12 000 $ або 500 000 грн": (12_000.0, "USD"), "€ 5 $ 100": (5.0, "USD"), "usd 1 200, eur 900": (1_200.0, "USD"),
        "завдаток 900 € або 38 000 грн, разом 42 000 000 грн, 1 000 000 $": (1_000_000.0, "USD"), "17 17 250 000 € центр": (250_000.0, "EUR"),
        "дол. 700": (700.0, "USD"), "uah100€ 20": (100.0, "UAH"), "10 $/м² 2000 грн": (2_000.0, "UAH"), "нічого": (None, None), None: (None, None),
        "1.234.567 грн": (None, "UAH"), "12,5 $": (12.5, "USD"),
    }
    rows = money.with_total_price(spark.createDataFrame([(t,) for t in texts], "t string"), F.col("t"))
    got = {r.t: (r.text_total, r.text_currency) for r in rows.collect()}
    assert got == texts
    assert money._candidates(F.col("t"), money.DEFAULT)._jc.toString().count("regexp_extract_all(") == 3


def test_first_element_equals_a_walk(spark):
    rng = random.Random(5)
    pieces = ["<div>", "<div class='x'>", "</div>", "<DIV>", "</Div >", "<b>", "</b>", "<divx>", "</divx>", " text ", "<br/>", "<", "a < b", "<!-- c -->", "</ div>"]
    texts = ["<div id=1>" + "".join(rng.choices(pieces, k=rng.randrange(9))) for _ in range(400)] + ["", "no tag", "</div>", "<div"]

    def walk(text):
        import re
        name = (re.match(r"<(\w+)", text, re.A) or [None, ""])[1].lower()
        depth, out = 1, None
        parts = re.split(r"(?=<)", text)
        parts = parts[1:] if parts and not parts[0] and text else parts
        out = parts[0] if parts else ""
        for piece in parts[1:]:
            own = (re.match(r"</?(\w+)", piece, re.A) or [None, ""])[1].lower() == name
            depth += 0 if not own else -1 if piece.startswith("</") else 1
            if not depth:
                return out
            out += piece
        return None

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", pages.first_element(F.col("t")).alias("e"))
    bad = [(r.t, r.e, walk(r.t)) for r in rows.collect() if r.t.startswith("<div") and r.e != walk(r.t)]
    assert not bad


def test_text_work_gets_more_tasks_as_rows_grow(spark, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 100)
    assert session.spread(spark.range(0, 5_000, 1, 6)).rdd.getNumPartitions() == 50
    assert session.spread(spark.range(0, 50, 1, 40)).rdd.getNumPartitions() == 40


def _mentions(df, text):
    return df._jdf.queryExecution().optimizedPlan().toString().count(text)


def test_a_rule_runs_once_for_a_value(spark):
    """A value that a rule names several times is bound first: its regex or path stands once in the plan."""
    rows = spark.createDataFrame([("$ 12 500",)], "text string")
    prices = money.with_total_price(rows, F.col("text"))
    assert _mentions(prices, money.PLAIN_NUMBER) == 1
    pages_ = rows.select(F.lit("domria").alias("source"), F.col("text").alias("url"), F.col("text").alias("html"), F.lit("2024-01-01").cast("timestamp").alias("fetched_at"))
    details = pages.detail_fields(pages_)
    assert _mentions(details, "$.areaServed") == 1 and _mentions(details, "$.seller.name") == 1 and _mentions(details, "$.priceCurrency") == 1


def test_pages_are_read_once_for_a_decision(spark):
    """Page state is parsed once per branch, visible text only of pages with one marker, price words only where the price is no number."""
    rows = spark.createDataFrame([("<html>",)], "html string").selectExpr(
        "'olx' AS source", "'sale' AS deal_type", "'kyiv' AS zone", "1 AS page_no", "'list' AS kind", "'u' AS url", "timestamp'2024-01-01' AS fetched_at", "html")
    assert _mentions(pages._olx(rows), "__PRERENDERED_STATE__=") == 2
    cards = pages.listings_from_cards(rows).select("price")
    assert _mentions(cards, "catalog-card-address") == 0 and _mentions(cards, "catalog-card-description") == 0
    state = lambda text: 'window.__PRERENDERED_STATE__="' + text + '";'
    ad = '{"listing":{"listing":{"ads":[{"id":7,"title":"a long title","url":"/d/7"}]}}}'
    htmls = [state(ad.replace('"', '\\"')), state(ad), state("{ " + ad[1:].replace('"', '\\"')), state('{\\"listing'), state("{}"), "", None, "captcha " + state(ad)]
    got = spark.createDataFrame([(str(n), h) for n, h in enumerate(htmls)], "url string, html string")
    assert [r[0] for r in got.orderBy("url").select(F.size(pages._state_ads(F.col("html")))).collect()] == [1, 1, 1, None, None, None, None, 1]
    found = pages.drop_blocked_pages(spark.createDataFrame([
        ("both", "captcha cloudflare " + "x " * 900), ("much", "captcha x"), ("little", "captcha " + "word " * 900), ("none", None), ("hidden", "<script>captcha</script>")], "url string, html string"))
    assert {r.url for r in found.collect()} == {"little", "none"}
