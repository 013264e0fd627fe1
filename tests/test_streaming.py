import time

from pyspark.sql import functions as F

from lotlens.operators.changes import absence_events, change_events, fold_observations, track_observations
from lotlens.operators.state import clean_cards
from lotlens.plans.views import observation_view
from lotlens.schemas import TABLES
from lotlens.session import scratch
from lotlens.sources.tables import conform
from lotlens.streaming import changes as K

CUTS = ["2024-01-08", "2024-01-15", "2024-01-22"]
COLUMNS = ["source", "external_id", "event_type", "occurred_at", "old_price", "new_price"]


def parts(spark, sf, cuts=CUTS):
    """The log cut into files, oldest first."""
    path = scratch(spark, "parts")
    obs = observation_view(spark, sf)
    edges = [None, *cuts, None]
    for low, high in zip(edges, edges[1:]):
        rows = obs
        if low:
            rows = rows.where(F.col("seen_at") >= low)
        if high:
            rows = rows.where(F.col("seen_at") < high)
        rows.coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    stream = spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return obs, stream


def expected(obs):
    until = obs.agg(F.max("seen_at")).first()[0]
    now = F.lit(until) - F.expr("INTERVAL 1 DAY")
    tracked = track_observations(obs, idle_hours=72)
    state = fold_observations(obs, idle_hours=72, as_of=now)
    changes = change_events(tracked).select(*COLUMNS[:4], "payload.old_price", "payload.new_price")
    return changes.unionByName(absence_events(tracked, state).select(*COLUMNS[:4]), allowMissingColumns=True)


def same(a, b):
    a, b = a.select(COLUMNS), b.select(COLUMNS)
    assert a.count() == b.count()
    assert a.exceptAll(b).count() == 0


def test_state_stream_equals_batch(spark, sf):
    obs, stream = parts(spark, sf)
    same(K.run_available(K.stream_changes(stream, 72), "changes"), expected(obs))


def late_parts(spark, sf):
    """The log in files by day; one card in three comes with the next file, and so up to 20 hours late."""
    path = scratch(spark, "late")
    obs = observation_view(spark, sf)
    late = (F.col("seq") % 3 == 0) & (F.hour("seen_at") >= 4)
    for low in range(0, 32, 4):
        day = F.dayofmonth("seen_at")
        came = F.when(late & (day % 4 == 3), day + 1).otherwise(day)
        obs.where((came >= low) & (came < low + 4)).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    return obs, spark.readStream.schema(obs.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_late_cards_give_the_events_of_the_batch_run(spark, sf):
    obs, stream = late_parts(spark, sf)
    ends = obs.agg(F.max("seen_at")).first()[0]
    shut = F.date_trunc("minute", F.lit(ends) - F.expr("INTERVAL 1 DAY"))
    closed = obs.where(F.col("seen_at") < shut)
    tracked = track_observations(closed, idle_hours=72)
    changes = change_events(tracked).select(*COLUMNS[:4], "payload.old_price", "payload.new_price")
    gone = absence_events(tracked, fold_observations(closed, idle_hours=72, as_of=shut)).select(*COLUMNS[:4])
    got = K.run_available(K.stream_ordered_changes(stream, 72), "ordered")
    same(got, changes.unionByName(gone, allowMissingColumns=True))


def test_timer_of_an_older_card_waits_for_held_cards(spark):
    path = scratch(spark, "older")
    schema = "source STRING, external_id STRING, seen_at TIMESTAMP, seq BIGINT, price DOUBLE, source_status_raw STRING"
    for one, other in ((0, 2), (5, 7), (12, 40)):
        spark.sql(f"""SELECT 's' AS source, id AS external_id, timestamp_seconds(1700000000 + h * 3600) AS seen_at, 1L AS seq, 5D AS price, '' AS source_status_raw
            FROM VALUES ('1', {one}), ('2', {other}) AS t(id, h)""").coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = K.run_available(K.stream_ordered_changes(stream, 10, "1 hour"), "older").where("external_id = '1'")
    hours = got.selectExpr("event_type", "CAST((unix_seconds(occurred_at) - 1700000000) / 3600 AS INT)").collect()
    assert sorted(map(tuple, hours)) == [("appeared", 0), ("vanished", 22)]


def test_hot_listing_out_of_order_in_many_batches(spark):
    """All cards of one listing, in any order, some equal in time and some twice."""
    rows = spark.range(6000).selectExpr(
        "'s' AS source", "'1' AS external_id", "timestamp_seconds(1700000000 + (id * 7919 % 5000) * 20) AS seen_at", "id AS seq",
        "CAST(id % 11 AS DOUBLE) AS price", "CASE WHEN id % 40 = 0 THEN 'inactive' WHEN id % 40 = 20 THEN 'active' END AS source_status_raw")
    end = rows.selectExpr("'s' AS source", "'2' AS external_id", "timestamp_seconds(1800000000) AS seen_at", "0L AS seq", "1D AS price", "'' AS source_status_raw")
    path = scratch(spark, "hot")
    for n in range(3):
        rows.where(F.col("seq") % 3 == n).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    end.coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        got = K.run_available(K.stream_ordered_changes(stream, 1, "3 days"), "hot").where("external_id = '1'")
        got = got.cache()
        got.count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    obs = rows.selectExpr("*", *[f"CAST(NULL AS {t}) AS {c}" for c, t in (
        ("currency", "STRING"), ("title", "STRING"), ("area_sqm", "DOUBLE"), ("description", "STRING"), ("phone", "STRING"), ("url", "STRING"), ("property_key", "STRING"))])
    tracked = track_observations(obs, idle_hours=1)
    changes = change_events(tracked).select(*COLUMNS[:4], "payload.old_price", "payload.new_price")
    same(got.where("event_type <> 'vanished'"), changes)


def test_batch_stream_equals_batch_also_with_hot_listings(spark, sf):
    obs, stream = parts(spark, sf)
    for hot in (10**6, 3):
        path = scratch(spark, "by-batch")
        query = stream.writeStream.foreachBatch(K.change_writer(path, hot_rows=hot)).option(
            "checkpointLocation", scratch(spark, "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
        same(spark.read.parquet(f"{path}/events"), expected(obs))


def mart(spark, stream, hot_rows=10**6, prepare=None):
    path = scratch(spark, "mart")
    cards = conform(stream, "observations").withColumn("property_key", F.col("external_id"))
    K.stream_to_mart(cards, path, scratch(spark, "cp"), prepare, hot_rows, parts=7).awaitTermination()
    tables = K.stream_mart(spark, path, 7)
    return tables.read("listings"), tables.read("events")


def test_mart_stream_is_the_batch_fold_for_any_cut(spark, sf):
    state = ["source", "external_id", "price", "title", "status", "first_seen_at", "last_seen_at", "vanished_at", "price_drop_count"]
    event = [*COLUMNS[:4], "payload.old_price", "payload.new_price", "payload.old_status", "payload.new_status"]
    for cuts, hot_rows in ((CUTS, 10**6), (["2024-01-11 07:30:00"], 3)):
        obs, stream = parts(spark, sf, cuts)
        listings, events = mart(spark, stream, hot_rows)
        want = fold_observations(obs).select(state)
        got = listings.select(state)
        assert got.count() == want.count() and got.exceptAll(want).count() == 0
        changes = change_events(track_observations(obs)).select(event)
        assert events.count() == changes.count() and events.select(event).exceptAll(changes).count() == 0


def test_mart_keeps_every_card_of_a_batch_and_stored_vanishing(spark):
    def cards(*rows):
        frame = spark.createDataFrame([("s", "1", p, t, n) for n, (p, t) in enumerate(rows)],
                                      "source STRING, external_id STRING, price DOUBLE, at STRING, seq BIGINT")
        return conform(frame.withColumn("seen_at", F.to_timestamp("at")), "observations").withColumn("property_key", F.lit("p"))

    path = scratch(spark, "mart")
    merge, tables = K.mart_writer(spark, path), K.stream_mart(spark, path)
    merge(cards((100.0, "2024-01-01"), (90.0, "2024-01-02"), (80.0, "2024-01-03")), 0)
    row = tables.read("listings").first()
    assert (row.price, str(row.last_seen_at), row.price_drop_count) == (80.0, "2024-01-03 00:00:00", 2)
    kinds = tables.read("events").orderBy("occurred_at").select("event_type").collect()
    assert [k[0] for k in kinds] == ["appeared", "price_changed", "price_changed"]

    gone = spark.createDataFrame(tables.read("listings").withColumns({
        "status": F.lit("vanished"), "vanished_at": F.to_timestamp(F.lit("2024-01-05"))}).collect(), TABLES["listings"])
    tables.commit(1, {"listings": (gone, tables.touched("listings", gone))})
    for _ in range(2):  # a repeated batch changes nothing
        merge(cards((70.0, "2024-01-06"), (70.0, "2024-01-07")), 2)
    row = tables.read("listings").first()
    assert (row.status, row.vanished_at, row.price_drop_count, str(row.first_seen_at)) == ("active", None, 3, "2024-01-01 00:00:00")
    kinds = tables.read("events").where("occurred_at > '2024-01-05'").select("event_type").collect()
    assert sorted(k[0] for k in kinds) == ["price_changed", "relisted"]


def test_mart_cleans_cards_first(spark, sf):
    """Micro-batches of cleaned cards leave what all cleaned cards leave at once."""
    obs, stream = parts(spark, sf, ["2024-01-16"])
    text = lambda df: df.withColumn("title", F.when(F.col("seq") % 3 == 0, "Офіс у центрі").when(F.col("seq") % 3 == 1, "Продаж магазину 120 м²"))
    names = ["source", "external_id", "price", "title", "property_type", "property_key", "status", "price_drop_count", "last_seen_at"]
    state = mart(spark, text(stream), prepare=clean_cards)[0].select(names)
    cards = clean_cards(conform(text(obs), "observations").withColumn("property_key", F.col("external_id")))
    path = scratch(spark, "mart")
    K.mart_writer(spark, path)(cards, 0)
    want = K.stream_mart(spark, path).read("listings").select(names)
    assert state.count() == want.count() > 0 and state.exceptAll(want).count() == 0 and want.where("property_type IS NOT NULL").count() > 0


def test_windows_closed_and_open_cover_the_log(spark, sf):
    obs, stream = parts(spark, sf)
    how = {"window": "1 day", "time": "seen_at", "by": ("source",)}
    got = K.run_available(K.stream_activity(stream, **how), "daily").unionByName(K.open_activity(obs, **how))
    want = obs.groupBy(F.date_trunc("day", "seen_at").alias("start"), "source").agg(F.count(F.lit(1)).alias("n"))
    assert got.count() == want.count()
    assert got.select("start", "source", "n").exceptAll(want).count() == 0
