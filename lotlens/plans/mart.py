"""The mart of the observation log, written once per session to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotlens.operators.changes import absence_events, change_events, fold_observations, track_observations
from lotlens.operators.deals import rescore_all
from lotlens.operators.market import is_active
from lotlens.plans.views import LOG_AS_OF, as_of, observation_view
from lotlens.session import stored

IDLE_HOURS = 72
_BUILT: dict[tuple[str, str], dict[str, DataFrame]] = {}


def build(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Listings, events, properties and hypotheses of the log, from its observations."""
    now = as_of(LOG_AS_OF)
    obs = observation_view(spark, root)
    tracked = stored(track_observations(obs, idle_hours=IDLE_HOURS), "tracked")
    listings = stored(fold_observations(obs, idle_hours=IDLE_HOURS, as_of=now), "listings")
    events = stored(change_events(tracked).unionByName(absence_events(tracked, listings), allowMissingColumns=True), "events")
    properties = stored(
        listings.groupBy("property_key").agg(
            F.min("deal_type").alias("deal_type"), F.min("district").alias("district"),
            F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"),
            F.bool_or(is_active()).alias("is_active"),
        ).withColumn("fingerprint", F.col("property_key")), "properties")
    deals = rescore_all(listings.withColumn("agency", F.col("district")), events, now)
    hypotheses = stored(
        deals.select(
            "property_key", "source", "external_id", "score", "bucket", "features",
            F.lit(None).cast("string").alias("human_label"), F.col("vanished_at").alias("created_at"),
            F.col("vanished_at").alias("updated_at"), "new_status",
        ), "hypotheses")
    return {"observations": obs, "tracked": tracked, "listings": listings, "events": events,
            "properties": properties, "hypotheses": hypotheses}


def log_mart(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    key = (spark.sparkContext.applicationId, root)
    if key not in _BUILT:
        _BUILT[key] = build(spark, root)
    return _BUILT[key]
