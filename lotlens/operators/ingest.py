"""One crawl into the mart: listings, premises, events and history change together, in one version."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotlens.config import DEFAULT, MarketConfig
from lotlens.operators.changes import KEY, dedupe_batch
from lotlens.operators.deals import apply_deal_marks, deal_candidates, merge_hypotheses, score_deals
from lotlens.operators.market import is_active
from lotlens.operators.state import merge_events, merge_properties, merge_snapshots, merge_state, next_listings, reconcile_vanish
from lotlens.session import stored
from lotlens.sources.versions import PARTS, VersionedTables

MART_KEYS = {"listings": KEY, "properties": ["fingerprint"], "hypotheses": ["property_key"]}


def mart_tables(spark: SparkSession, root: str, parts: int = PARTS) -> VersionedTables:
    """Listings, premises and hypotheses by key, events and snapshots appended."""
    return VersionedTables(spark, root, MART_KEYS, parts)


def ingest_crawl(mart: VersionedTables, batch: int, cards: DataFrame, prepare: Callable[[DataFrame], DataFrame] = dedupe_batch) -> None:
    """Merges the cards of one crawl, one per listing, and commits all tables as batch ``batch``.

    ``prepare`` makes the crawl's cards unique, and clean (`operators.state.clean_observations`). Only the parts that the cards' listings and
    premises fall into are read and written. A crawl that is merged again, or stops half-way, leaves what one whole merge leaves.
    """
    rows = stored(prepare(cards), "crawl")
    premises_of = rows.selectExpr("property_key AS fingerprint")
    parts, homes = mart.touched("listings", rows), mart.touched("properties", premises_of)
    merged = stored(merge_state(mart.read("listings", parts, before=batch), rows), "merged")
    listings = stored(next_listings(merged), "listings")
    premises, born = merge_properties(mart.read("properties", homes, before=batch), rows)
    mart.commit(
        batch, {"listings": (listings, parts), "properties": (premises, homes)},
        {"events": merge_events(merged).unionByName(born), "snapshots": merge_snapshots(merged, listings)})


def vanish_crawl(mart: VersionedTables, batch: int, seen: DataFrame, as_of: Column, cfg: MarketConfig = DEFAULT) -> DataFrame:
    """The vanish pass after a crawl that saw the listings ``seen`` (source, external_id), committed as batch ``batch``; returns the coverage guard.

    Unseen listings of sources the guard allows become vanished; premises that so lost their last listing get one event and a scored
    hypothesis, whose explicit status marks its listing. Listings, premises, hypotheses and events change in one commit, and only the parts with
    a change are written. The listings are read whole, as absence needs all of them; premises, events and scores follow what vanished.
    """
    events = mart.read("events", before=batch)
    result = reconcile_vanish(mart.read("listings", before=batch), events, seen, as_of, cfg=cfg)
    fresh = stored(result.new_events, "vanish-events")
    gone, marked = result.listings.where("newly_vanished"), result.listings.drop("newly_vanished")

    def of(rows: DataFrame, premises: DataFrame) -> DataFrame:
        return rows.join(premises.select("property_key").distinct(), "property_key", "left_semi")

    scored = stored(score_deals(deal_candidates(of(marked, fresh), of(events, fresh), as_of, cfg, everyone=marked), cfg), "scored")
    live = of(marked, gone).groupBy(F.col("property_key").alias("fingerprint")).agg(F.bool_or(is_active()).alias("_live"))
    parts = mart.touched("listings", gone, scored)
    homes = mart.touched("properties", gone.selectExpr("property_key AS fingerprint"))
    told = mart.touched("hypotheses", scored)
    premises = mart.read("properties", homes, before=batch).join(live, "fingerprint", "left")
    mart.commit(batch, {
        "listings": (apply_deal_marks(marked.where(mart.part("listings").isin(parts)), scored), parts),
        "properties": (premises.withColumn("is_active", F.coalesce("_live", "is_active")), homes),
        "hypotheses": (merge_hypotheses(mart.read("hypotheses", told, before=batch), scored, as_of), told),
    }, {"events": fresh})
    return result.guard
