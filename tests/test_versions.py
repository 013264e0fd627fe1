"""Versioned tables: what a batch moves, repeated and broken batches, several tables at once."""

import pathlib

import pytest
from pyspark.sql import functions as F

from lotlens.config import MarketConfig
from lotlens.operators.ingest import mart_tables, vanish_crawl
from lotlens.operators.quality import clean_junk
from lotlens.schemas import TABLES
from lotlens.session import scratch
from lotlens.sources.tables import conform
from lotlens.sources.versions import VersionedTables

KEYS = {"listings": ["source", "external_id"], "properties": ["fingerprint"]}


def listings(spark, ids, price):
    return conform(spark.createDataFrame([("s", str(i), price) for i in ids], "source STRING, external_id STRING, price DOUBLE"), "listings")


def merged(tables, batch, rows):
    """Replaces listings of the same key."""
    touched = tables.touched("listings", rows)
    old = tables.read("listings", touched, before=batch)
    return old.join(rows, KEYS["listings"], "left_anti").unionByName(rows), touched


def prices(tables):
    return {r.external_id: r.price for r in tables.read("listings").collect()}


def size(root, version):
    return sum(f.stat().st_size for f in pathlib.Path(root.removeprefix("file:")).glob(f"listings/version={version}/**/*.parquet"))


def test_a_batch_moves_its_own_parts_only(spark):
    root = scratch(spark, "versions")
    tables = VersionedTables(spark, root, KEYS, parts=16)
    assert tables.read("listings").count() == 0 and tables.read("events").count() == 0
    tables.commit(0, {"listings": merged(tables, 0, listings(spark, range(2000), 1.0))})
    tables.commit(1, {"listings": merged(tables, 1, listings(spark, [5], 2.0))})
    held = tables.manifest()
    assert sorted(held.values()) == [0] * 15 + [1] and prices(tables) == {str(i): 2.0 if i == 5 else 1.0 for i in range(2000)}
    assert 0 < size(root, 1) < size(root, 0) / 8
    tables.commit(2, {"listings": merged(tables, 2, listings(spark, [5, 3000], 3.0))})
    assert prices(tables)["5"] == prices(tables)["3000"] == 3.0 and len(prices(tables)) == 2001
    # files that no newer manifest names are gone, those of the last two are not
    assert tables.read("listings", before=2).where("external_id = '5'").first().price == 2.0
    part = next(p for (t, p), v in tables.manifest(1).items() if held[t, p] == 1)
    assert not pathlib.Path(f"{root}/listings/version=0/part={part}".removeprefix("file:")).exists()


def test_repeated_and_broken_batches(spark):
    root = scratch(spark, "versions")
    tables = VersionedTables(spark, root, KEYS, parts=4)
    tables.commit(0, {"listings": merged(tables, 0, listings(spark, range(20), 1.0))}, {"events": conform(spark.range(3).selectExpr("'a' AS event_type"), "events")})

    def batch():
        rows, touched = merged(tables, 1, listings(spark, range(10, 30), 2.0).withColumn("price", F.col("price") * 2))
        return {"listings": (rows, touched)}, {"events": conform(spark.range(2).selectExpr("'b' AS event_type"), "events")}

    changed, events = batch()
    with pytest.raises(Exception, match="stopped"):  # the table is written, the rows to append fail
        tables.commit(1, changed, {"events": events["events"].withColumn("event_type", F.raise_error(F.lit("stopped")).cast("string"))})
    assert set(prices(tables).values()) == {1.0} and tables.read("events").count() == 3 and tables.batches() == [0]
    for _ in range(2):
        tables.commit(1, *batch())
        assert prices(tables) == {str(i): 4.0 if i >= 10 else 1.0 for i in range(30)} and tables.read("events").count() == 5


def test_tables_change_together_and_parts_can_empty(spark):
    root = scratch(spark, "versions")
    tables = VersionedTables(spark, root, KEYS, parts=2)
    premises = conform(spark.range(9).selectExpr("string(id) AS fingerprint", "true AS is_active"), "properties")
    tables.commit(0, {"listings": merged(tables, 0, listings(spark, range(9), 1.0)), "properties": (premises, range(2))})
    tables.commit(1, {"listings": (spark.createDataFrame([], TABLES["listings"]), [0, 1]), "properties": (premises.where("fingerprint > '4'"), range(2))})
    assert tables.read("listings").count() == 0 and tables.read("properties").count() == 4
    assert tables.read("listings", before=1).count() == 9 and tables.read("properties", before=1).count() == 9
    tables.commit(2, {})
    assert tables.read("properties").count() == 4


def test_vanish_pass_again_and_nothing_to_do(spark):
    """One premises with two listings, one with a sold listing, one still seen; the pass twice, then one that sees all that is left."""
    at = F.to_timestamp(F.lit("2024-03-01"))
    rows = spark.sql("""SELECT s AS source, e AS external_id, p AS property_key, 'active' AS status, 'sale' AS deal_type, 9D AS price, r AS source_status_raw, 0 AS price_drop_count,
        timestamp'2024-01-01' AS first_seen_at, timestamp'2024-02-01' AS last_seen_at FROM VALUES ('a', '1', 'x', ''), ('b', '2', 'x', ''), ('a', '3', 'y', 'sold'), ('b', '4', 'z', ''), ('a', '5', NULL, '') AS t(s, e, p, r)""")
    mart = mart_tables(spark, scratch(spark, "vanish"), parts=3)
    premises = spark.sql("SELECT p AS fingerprint, true AS is_active FROM VALUES ('x'), ('y'), ('z') AS t(p)")
    mart.commit(0, {"listings": (conform(rows, "listings"), range(3)), "properties": (conform(premises, "properties"), range(3))})
    seen = rows.where("external_id IN ('2', '4')").select("source", "external_id")
    loose = MarketConfig(min_seen_for_vanish=1, vanish_min_active_ratio=0.0)
    two = seen.unionByName(spark.sql("SELECT 'a' AS source, 'new' AS external_id"))
    for _ in range(2):
        vanish_crawl(mart, 1, two, at, loose)
        status = {r.external_id: r.status for r in mart.read("listings").collect()}
        assert status == {"1": "vanished", "2": "active", "3": "sold_marked", "4": "active", "5": "vanished"}
        assert {r.fingerprint: r.is_active for r in mart.read("properties").collect()} == {"x": True, "y": False, "z": True}
        assert [(r.property_key, r.external_id) for r in mart.read("hypotheses").collect()] == [("y", "3")]
        assert [(r.event_type, r.property_key) for r in mart.read("events").collect()] == [("vanished", "y")]
    vanish_crawl(mart, 2, two, at, loose)
    assert mart.read("events").count() == 1 and mart.read("hypotheses").count() == 1 and {r.external_id: r.status for r in mart.read("listings").collect()} == status


def test_tombstones(spark):
    tables = VersionedTables(spark, scratch(spark, "graves"), KEYS, parts=4)
    rows = listings(spark, range(40), 1.0).withColumn("property_key", F.lit("p"))
    events = conform(rows.select("source", "external_id", F.when(F.col("external_id").cast("int") < 20, "old").otherwise("p").alias("property_key")), "events")
    tables.commit(0, {"listings": (rows, range(4))}, {"events": events})
    dead = rows.where("external_id in ('3', '4', '25')").select(*KEYS["listings"])
    home = spark.createDataFrame([("old",)], "property_key STRING")
    for _ in range(2):  # a repeated batch changes nothing
        tables.commit(1, {}, buried={"listings": [dead.unionByName(dead)], "events": [dead, home]})
        assert set(prices(tables)) == {str(i) for i in range(40)} - {"3", "4", "25"}
        assert {int(r.external_id) for r in tables.read("events").collect()} == set(range(20, 40)) - {25}
    assert size(tables.root, 1) == 0 and tables.read("listings", before=1).count() == 40  # no table is rewritten

    back = listings(spark, [4], 2.0)  # a listing that comes back lives, its part loses the dead rows
    frame, parts = merged(tables, 2, back)
    tables.commit(2, {"listings": (frame, parts)}, {"events": conform(back, "events")})
    assert prices(tables)["4"] == 2.0 and "3" not in prices(tables) and len(prices(tables)) == 38
    assert "4" in {r.external_id for r in tables.read("events").collect()}

    before = prices(tables)
    left = tables.compact(3, "listings")
    assert set(left) == set(tables.touched("listings", dead)) - set(parts) and prices(tables) == before
    assert tables.compact(4, "listings") == []
    held = [f"{tables.root}/listings/version={v}/part={p}" for (t, p), v in tables.manifest().items() if t == "listings"]
    assert spark.read.schema(TABLES["listings"]).parquet(*held).count() == len(before)  # no dead row is left in a file


def test_unfinished_burial_is_not_seen(spark):
    tables = VersionedTables(spark, scratch(spark, "graves"), KEYS, parts=2)
    rows = listings(spark, range(6), 1.0)
    tables.commit(0, {"listings": (rows, range(2))})
    rows.select(*KEYS["listings"]).write.parquet(f"{tables.root}/tombstones/listings/by=source+external_id/version=1")
    assert len(prices(tables)) == 6


def test_cascade_by_keys(spark):
    mart = mart_tables(spark, scratch(spark, "cascade"), parts=2)
    rows = spark.createDataFrame(
        [("domria", str(i), f"p{i % 4}", f"https://x/realty-{'lviv' if i % 4 == 1 or i == 2 else 'kiev'}-{i}", -5.0 if i == 3 else 900.0) for i in range(8)]
        + [("domria", "none", None, None, None)], "source STRING, external_id STRING, property_key STRING, url STRING, price DOUBLE")
    homes = rows.where("property_key is not null").selectExpr("property_key AS fingerprint").distinct()
    mart.commit(0, {"listings": (conform(rows, "listings"), range(2)), "properties": (conform(homes, "properties"), range(2)),
                    "hypotheses": (conform(rows, "hypotheses"), range(2))},
                {"events": conform(rows, "events"), "snapshots": conform(rows, "snapshots")})
    removed, lost = clean_junk(mart, 1)
    assert {r.external_id for r in removed.collect()} == {"1", "2", "5"} and {r.fingerprint for r in lost.collect()} == {"p1"}
    for name in ("listings", "events", "snapshots", "hypotheses"):
        assert {r.external_id for r in mart.read(name).collect()} == {"0", "3", "4", "6", "7", "none"}, name
    assert {r.fingerprint for r in mart.read("properties").collect()} == {"p0", "p2", "p3"}
    kept = prices(mart)
    assert kept["3"] is None and kept["0"] == 900.0 and len(kept) == 6
