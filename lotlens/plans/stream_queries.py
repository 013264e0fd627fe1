"""Streaming queries over the events table as a file stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotlens.plans.check_sql import MISSED_BY_IDLE, OBS, mapped, tracked, ts, with_
from lotlens.plans.registry import big, query, stamp
from lotlens.plans.views import event_stream, observation_view
from lotlens.session import scratch
from lotlens.sources.tables import conform
from lotlens.streaming import changes as K


def _stream(spark, root):
    return observation_view(spark, root, event_stream(spark, root))


@query("stream_deduplicated", with_(OBS, body="SELECT DISTINCT source, external_id, strftime(seen_at, '%Y-%m-%d') AS day FROM obs"))
def stream_deduplicated(spark, root):
    rows = _stream(spark, root).withColumn("day", F.date_format("seen_at", "yyyy-MM-dd"))
    once = K.dedupe_stream(rows, ["source", "external_id", "day"]).select("source", "external_id", "day")
    return K.run_available(once, "dedupe")


STREAM_SQL = """wm AS (SELECT max(seen_at) - INTERVAL 1 DAY AS at FROM obs),
lastrow AS (SELECT source, external_id, max(seen_at) AS last_seen, arg_max(source_status_raw, (seen_at, seq)) FILTER (source_status_raw IS NOT NULL) AS raw FROM obs GROUP BY 1, 2),
sev AS (SELECT source, external_id, event_type, occurred_at, old_price, new_price FROM chg
  UNION ALL SELECT source, external_id, 'vanished', stored_vanished_at, NULL, NULL FROM trk WHERE prev_mapped = 'active' AND stored_status = 'vanished'
  UNION ALL SELECT source, external_id, 'vanished', last_seen + INTERVAL 72 HOUR, NULL, NULL FROM lastrow, wm
    WHERE (raw IS NULL OR raw = 'active') AND last_seen + INTERVAL 72 HOUR < wm.at)"""


@query("stream_changes", with_(OBS, tracked(MISSED_BY_IDLE), STREAM_SQL, body=f"SELECT source, external_id, event_type, {ts('occurred_at')}, old_price, new_price FROM sev"))
def stream_changes(spark, root):
    rows = K.run_available(K.stream_changes(_stream(spark, root), 72), "changes")
    return rows.select("source", "external_id", "event_type", stamp("occurred_at"), "old_price", "new_price")


@query("stream_changes_by_batch", with_(OBS, tracked(MISSED_BY_IDLE), STREAM_SQL, body=f"SELECT source, external_id, event_type, {ts('occurred_at')}, old_price, new_price FROM sev"))
def stream_changes_by_batch(spark, root):
    path = scratch(spark, "changes-by-batch")
    K.stream_changes_by_batch(_stream(spark, root), path, scratch(spark, "changes-by-batch-cp")).awaitTermination()
    rows = spark.read.parquet(f"{path}/events")
    return rows.select("source", "external_id", "event_type", stamp("occurred_at"), "old_price", "new_price")


# Cards before the last whole minute that the watermark has passed.
CLOSED_SQL = (OBS.replace("obs AS (", "arrived AS (", 1), """wm AS (SELECT date_trunc('minute', max(seen_at) - INTERVAL 1 DAY) AS at FROM arrived),
obs AS (SELECT arrived.* FROM arrived, wm WHERE seen_at < wm.at)""")


@query("stream_late_changes", with_(*CLOSED_SQL, tracked(MISSED_BY_IDLE), STREAM_SQL.split("\n", 1)[1], body=f"SELECT source, external_id, event_type, {ts('occurred_at')}, old_price, new_price FROM sev"))
def stream_late_changes(spark, root):
    """The log in two files, the odd cards of the last 20 hours of the first file come with the second."""
    obs = observation_view(spark, root)
    days = obs.agg(F.min("seen_at").alias("low"), F.max("seen_at").alias("high")).first()
    cut = F.lit(days.low + (days.high - days.low) / 2)
    late = (F.col("seen_at") >= cut - F.expr("INTERVAL 20 HOURS")) & (F.col("seq") % 2 == 1)
    log = scratch(spark, "late-log")
    first = (F.col("seen_at") < cut) & ~late
    checkpoint, out = scratch(spark, "late-cp"), scratch(spark, "late")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", K.ROCKSDB)
    for part in (first, ~first):
        obs.where(part).write.mode("append").parquet(log)
        changes = K.stream_ordered_changes(spark.readStream.schema(obs.schema).parquet(log), 72)
        changes.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(changes.schema).parquet(out)
    return rows.select("source", "external_id", "event_type", stamp("occurred_at"), "old_price", "new_price")


@query("stream_vanish_counts", with_(OBS, tracked(MISSED_BY_IDLE), STREAM_SQL, body="SELECT source, event_type, count(*) AS n FROM sev WHERE event_type IN ('vanished', 'relisted') GROUP BY 1, 2"))
def stream_vanish(spark, root):
    rows = K.run_available(K.stream_changes(_stream(spark, root), 72), "vanish")
    return rows.where(F.col("event_type").isin("vanished", "relisted")).groupBy("source", "event_type").agg(F.count(F.lit(1)).alias("n"))


def _activity(spark, root, window, slide, name):
    """Windows the stream has closed, and those it still holds open."""
    how = {"window": window, "slide": slide, "time": "seen_at", "by": ("source",)}
    closed = K.run_available(K.stream_activity(_stream(spark, root), **how), name)
    return closed.unionByName(K.open_activity(observation_view(spark, root), **how)).select(stamp("start"), "source", "n")


@query("stream_daily_activity", with_(OBS, body="""SELECT strftime(date_trunc('day', seen_at), '%Y-%m-%d %H:%M:%S') AS start, source, count(*) AS n FROM obs GROUP BY 1, 2"""))
def stream_daily(spark, root):
    return _activity(spark, root, "1 day", None, "daily")


@query("stream_weekly_activity", with_(OBS, body="""SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, source, count(*) AS n FROM
(SELECT source, unnest(generate_series(date_trunc('day', seen_at) - INTERVAL 6 DAY, date_trunc('day', seen_at), INTERVAL 1 DAY)) AS s FROM obs)
GROUP BY 1, 2"""))
def stream_weekly(spark, root):
    return _activity(spark, root, "7 days", "1 day", "weekly")


MART_STATE_SQL = """kinds AS (SELECT source, external_id, count(*) FILTER (event_type = 'appeared') AS appeared, count(*) FILTER (event_type = 'price_changed') AS price_changed,
  count(*) FILTER (event_type = 'status_changed') AS status_changed, count(*) FILTER (event_type = 'relisted') AS relisted FROM chg GROUP BY 1, 2),
drops AS (SELECT source, external_id, count(*) FILTER (price_dropped) AS price_drop_count FROM trk GROUP BY 1, 2),
state AS (SELECT source, external_id, arg_max(price, (seen_at, seq)) FILTER (price IS NOT NULL) AS price, arg_max(title, (seen_at, seq)) FILTER (title IS NOT NULL) AS title,
  arg_max(source_status_raw, (seen_at, seq)) FILTER (source_status_raw IS NOT NULL) AS raw, min(seen_at) AS first_seen_at, max(seen_at) AS last_seen_at FROM obs GROUP BY 1, 2)"""
NEVER = "CAST(NULL AS TIMESTAMP)"


@query("stream_to_mart", with_(OBS, tracked(NEVER), MART_STATE_SQL, body=f"""SELECT source, external_id, price, title, {mapped('raw')} AS status, {ts('first_seen_at')}, {ts('last_seen_at')},
  price_drop_count, appeared, price_changed, status_changed, relisted FROM state JOIN drops USING (source, external_id) JOIN kinds USING (source, external_id)"""))
def stream_mart(spark, root):
    """The log arrives in three parts, oldest first; each run merges all that is new into the mart."""
    path, log, checkpoint = (scratch(spark, n) for n in ("stream-mart", "stream-mart-log", "stream-mart-cp"))
    obs = conform(observation_view(spark, root).withColumn("property_key", F.col("external_id")), "observations")
    span = obs.agg(F.min("seen_at").alias("low"), F.max("seen_at").alias("high")).first()
    third = (span.high - span.low) / 3
    part = F.when(F.col("seen_at") < span.low + third, 0).when(F.col("seen_at") < span.low + 2 * third, 1).otherwise(2)
    for n in range(3):
        obs.where(part == n).write.mode("append").parquet(log)
        stream = spark.readStream.schema(obs.schema).parquet(log).withColumn("property_key", F.col("external_id"))
        K.stream_to_mart(stream, path, checkpoint, parts=8).awaitTermination()
    mart = K.stream_mart(spark, path, 8)
    listings = mart.read("listings")
    events = mart.read("events").groupBy("source", "external_id").agg(*[
        F.count_if(F.col("event_type") == kind).alias(kind) for kind in ("appeared", "price_changed", "status_changed", "relisted")])
    return listings.join(events, ["source", "external_id"]).select(
        "source", "external_id", "price", "title", "status", stamp("first_seen_at"), stamp("last_seen_at"), *big("price_drop_count"),
        "appeared", "price_changed", "status_changed", "relisted")
