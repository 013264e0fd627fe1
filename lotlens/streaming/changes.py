"""Structured Streaming counterparts of change detection, vanish timers and counters."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from numpy.lib.recfunctions import repack_fields
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from lotlens.functions.rules import STATUS_WORDS
from lotlens.functions.text import map_status
from lotlens.operators.changes import KEY, STICKY, change_events, track_observations
from lotlens.operators.relational import HOT_ROWS
from lotlens.operators.state import fold_cards, mart_events, merge_state, next_listings, track_cards
from lotlens.session import scratch, stored
from lotlens.sources.versions import PARTS, VersionedTables

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGE_SCHEMA = (
    "source STRING, external_id STRING, event_type STRING, occurred_at TIMESTAMP, old_price DOUBLE, "
    "new_price DOUBLE, old_status STRING, new_status STRING"
)
CARD_STATE = "price DOUBLE, raw_status STRING, last_seen TIMESTAMP, gone_at TIMESTAMP"
CARD_FIELDS = ["seen_at", "seq", "price", "source_status_raw"]
NEVER = np.iinfo(np.int64).min
#: Waiting cards and the state of a bucket's listings as columns of numbers; times in microseconds, a status by its place in ``STATED``.
CARD_COLUMNS = [("at", "<i8"), ("seq", "<i8"), ("price", "<f8"), ("listing", "<i4")]
CARD = np.dtype([*CARD_COLUMNS, ("stated", "u1")])
LISTING = np.dtype([("price", "<f8"), ("last", "<i8"), ("gone", "<i8"), ("stated", "u1")])
HELD_CARDS = "stated BINARY, cards BINARY"
STATED = (None, "active", *[status for status, _ in STATUS_WORDS])
ACTIVE, VANISHED, RELISTED = 1, STATED.index("vanished"), len(STATED)
KINDS = np.array(["appeared", "vanished", "relisted", "price_changed", "status_changed"], dtype=object)
#: Spans of an entry of waiting cards, and the cards from which it is cut into entries of the next width.
WIDTHS = (16_384, 2_048, 256, 32, 1)
HELD_ROWS = 20_000
#: Groups of listings that `stream_ordered_changes` keeps its state by; fixed for the life of a checkpoint.
BUCKETS = 1_024


def dedupe_stream(obs: DataFrame, keys: list[str], delay: str = "2 days", time: str = "seen_at") -> DataFrame:
    """First card per key within the watermark delay."""
    return obs.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def _status(raw: str | None) -> str:
    low = (raw or "").lower()
    for status, words in STATUS_WORDS:
        if any(w in low for w in words):
            return status
    return "active"


def change_processor(idle_hours: int) -> StatefulProcessor:
    """Stateful change detector with an inactivity timer per listing."""
    return _ChangeDetector(idle_hours)


class _ChangeDetector(StatefulProcessor):
    """Keeps price, status, last seen and missing time of one listing.

    Only the four card fields reach Python; a listing idle for ``idle_hours`` is reported
    vanished by its event-time timer, or by the gap its next card closes.
    """

    def __init__(self, idle_hours: int):
        self.idle = timedelta(hours=idle_hours)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.card = handle.getValueState("card", CARD_STATE)

    def _step(self, key, state, seen, value: float | None, stated: str | None, events: list[tuple]) -> tuple:
        """The state after a card; what the card changed is added to ``events``."""
        price, raw, last, gone = state
        before = None if last is None else _status(raw)
        if last is None:
            events.append((*key, "appeared", seen, None, None, None, None))
        else:
            if before == "active" and gone is None and last + self.idle < seen:
                gone = last + self.idle
                events.append((*key, "vanished", gone, None, None, None, None))
            if gone is not None or before == "vanished":
                before = "relisted"
                events.append((*key, "relisted", seen, None, None, None, None))
            if price is not None and value is not None and value != price:
                events.append((*key, "price_changed", seen, price, value, None, None))
        raw = stated or raw
        after = _status(raw)
        if last is not None and after != "active" and after != before:
            events.append((*key, "status_changed", seen, None, None, before, after))
        return value if value is not None else price, raw, seen, None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        cards = pd.concat(list(rows)).sort_values(["seen_at", "seq"])
        price = raw = last = gone = None
        if self.card.exists():
            price, raw, last, gone = self.card.get()
        events = []
        for seen, value, stated in zip(cards["seen_at"], cards["price"], cards["source_status_raw"]):
            value = None if pd.isna(value) else float(value)
            price, raw, last, gone = self._step(key, (price, raw, last, gone), seen.to_pydatetime(), value, stated or None, events)
        self.card.update((price, raw, last, None))
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        if _status(raw) == "active":
            self.handle.registerTimer(int((pd.Timestamp(last) + self.idle).timestamp() * 1000) + 1)
        yield _frame(events)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        price, raw, last, gone = self.card.get()
        if gone is None and _status(raw) == "active":
            gone = last + self.idle
            self.card.update((price, raw, last, gone))
            yield _frame([(*key, "vanished", gone, None, None, None, None)])

    def close(self) -> None:
        pass


class _OrderedDetector(StatefulProcessor):
    """The rules of `_ChangeDetector` for cards that arrive out of order, up to the watermark's delay; a key holds one listing or many.

    Cards wait in a map until the watermark passes the end of their time span, and are then released in time order. An entry of the map holds
    the cards of ``WIDTHS[0]`` spans; one that outgrows ``HELD_ROWS`` cards is cut into entries of fewer spans, down to one, and an empty
    entry marks the cut. So a key of few cards costs few calls to its state, and memory holds one Arrow batch, ``HELD_ROWS`` cards, or the
    cards of one key and span, beside a row per listing of the key. The cards of all listings of an entry are compared as columns. A key has one timer: the end of the
    first span that waits, or of the span in which the first idle time ends; an idle listing is told after the cards of that span.
    """

    def __init__(self, idle_hours: int, span_seconds: int):
        self.idle = idle_hours * 3_600_000_000
        self.span = span_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.names = handle.getValueState("names", "source ARRAY<STRING>, external_id ARRAY<STRING>")
        self.listings = handle.getValueState("listings", "listings BINARY")
        self.held = handle.getMapState("held", "width INT, start BIGINT", HELD_CARDS)
        self.alarm = handle.getValueState("alarm", "at BIGINT")

    def _ends(self, at):
        """End of the span of a time, in microseconds."""
        return at - at % self.span + self.span

    def _wake(self, ends: int) -> None:
        """Sets the key's one timer to the end of a span, unless it rings before that."""
        alarm = self.alarm.get()
        if alarm is not None:
            if alarm[0] <= ends:
                return
            self.handle.deleteTimer(alarm[0] // 1000)
        self.alarm.update((ends,))
        self.handle.registerTimer(ends // 1000)

    def _waiting(self, place: tuple[int, int]) -> np.ndarray:
        stated, columns = self.held.getValue(place)
        cards = np.empty(len(stated), CARD)
        cards["stated"] = np.frombuffer(stated, "u1")
        rest = np.frombuffer(columns, np.dtype(CARD_COLUMNS))
        for name, _ in CARD_COLUMNS:
            cards[name] = rest[name]
        return cards

    def _put(self, place: tuple[int, int], cards: np.ndarray) -> None:
        self.held.updateValue(place, (cards["stated"].tobytes(), repack_fields(cards[[name for name, _ in CARD_COLUMNS]]).tobytes()))

    def _hold(self, cards: np.ndarray, level: int = 0) -> None:
        width = WIDTHS[level] * self.span
        starts = cards["at"] - cards["at"] % width
        for start in np.unique(starts).tolist():
            place, cut, found = (WIDTHS[level], start), False, cards[starts == start]
            if self.held.containsKey(place):
                waiting = self._waiting(place)
                cut, found = not len(waiting), np.concatenate([waiting, found])
            if level + 1 < len(WIDTHS) and (cut or len(found) > HELD_ROWS):
                if not cut:
                    self._put(place, found[:0])
                self._hold(found, level + 1)
            else:
                self._put(place, found)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, known = None, list(zip(*self.names.get())) if self.names.exists() else []
        places, before = {name: n for n, name in enumerate(known)}, len(known)
        for batch in rows:
            cards = np.zeros(len(batch), CARD)
            cards["at"] = batch["seen_at"].to_numpy().astype("datetime64[us]").astype("int64")
            cards["seq"], cards["price"] = batch["seq"].astype("int64"), batch["price"].astype("float64")
            names = zip(batch["source"], batch["external_id"]) if "external_id" in batch else [key] * len(batch)
            cards["listing"] = [places.setdefault(name, len(places)) for name in names]
            codes, texts = pd.factorize(batch["source_status_raw"])
            cards["stated"] = np.array([*[STATED.index(_status(t)) if t else 0 for t in texts], 0], "u1")[codes]
            self._hold(cards)
            least = int(cards["at"].min())
            first = least if first is None else min(first, least)
        if len(places) > before:
            self.names.update(tuple(map(list, zip(*places))))
        if first is not None:
            self._wake(self._ends(first))
        return iter(())

    def _step(self, cards: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, ...]:
        """Columns of the events of cards in order of listing and time; ``state`` (a row per listing) becomes that after them."""
        listing, at, price, stated = (cards[c] for c in ("listing", "at", "price", "stated"))
        order, old = np.arange(len(cards)), state[listing]
        first = np.append(True, listing[1:] != listing[:-1])

        def carried(value, known, kept):
            """(value before a card, value after it), where a card may name none."""
            named = np.where(known, value, kept)
            after = named[np.maximum.accumulate(np.where(known | first, order, 0))]
            return np.where(first, kept, np.roll(after, 1)), after

        price_before, price_after = carried(price, ~np.isnan(price), old["price"])
        stated_before, stated_after = carried(stated, stated > 0, old["stated"])
        last = np.where(first, old["last"], np.roll(at, 1))
        gone = np.where(first, old["gone"], NEVER)
        seen = last != NEVER
        before, after = np.maximum(stated_before, ACTIVE), np.maximum(stated_after, ACTIVE)
        idle = seen & (before == ACTIVE) & (gone == NEVER) & (last + self.idle < at)
        back = seen & (idle | (gone != NEVER) | (before == VANISHED))
        before = np.where(back, RELISTED, before)
        repriced = seen & ~np.isnan(price_before) & ~np.isnan(price) & (price != price_before)
        restated = seen & (after != ACTIVE) & (after != before)
        found = [np.flatnonzero(x) for x in (~seen, idle, back, repriced, restated)]
        row, kind = np.concatenate(found), np.repeat(np.arange(len(found)), [len(x) for x in found])
        in_order = np.lexsort((kind, row))
        row, kind = row[in_order], kind[in_order]
        ends = np.flatnonzero(np.append(first[1:], True))
        state["price"][listing[ends]], state["last"][listing[ends]] = price_after[ends], at[ends]
        state["gone"][listing[ends]], state["stated"][listing[ends]] = NEVER, stated_after[ends]
        of_price, of_status = kind == 3, kind == 4
        return (
            listing[row], kind, np.where(kind == 1, last[row] + self.idle, at[row]),
            np.where(of_price, price_before[row], np.nan), np.where(of_price, price[row], np.nan),
            np.where(of_status, before[row], 0), np.where(of_status, after[row], 0),
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        names = [np.array(column, dtype=object) for column in self.names.get()]
        state = np.zeros(len(names[0]), LISTING)
        state["price"], state["last"], state["gone"] = np.nan, NEVER, NEVER
        if self.listings.exists():
            kept = np.frombuffer(self.listings.get()[0], LISTING)
            state[: len(kept)] = kept
        self.alarm.clear()
        following = None
        # entries with cards do not overlap, so their starts give time order
        places = sorted(((k[0], k[1]) for k in self.held.keys()), key=lambda place: (place[1], -place[0]))
        for place in places:
            cards = self._waiting(place)
            waits = self._ends(cards["at"]) > now
            waiting, due = cards[waits], cards[~waits]
            if len(due):
                events = self._step(due[np.lexsort((due["seq"], due["at"], due["listing"]))], state)
                if len(events[0]):
                    yield _event_frame(names, *events)
            if not len(waiting) and (len(cards) or place[1] + place[0] * self.span <= now):
                self.held.removeKey(place)
            elif len(waiting) and len(due):
                self._put(place, waiting)
            if len(waiting):
                following = int(self._ends(waiting["at"].min()))
                break
        active = np.flatnonzero((state["last"] != NEVER) & (state["gone"] == NEVER) & (state["stated"] <= ACTIVE))
        gone = state["last"][active] + self.idle
        told = self._ends(gone)
        idle, later = active[told <= now], told[told > now]
        state["gone"][idle] = gone[told <= now]
        if len(later):
            following = int(later.min()) if following is None else min(following, int(later.min()))
        self.listings.update((state.tobytes(),))
        if following is not None:
            self._wake(following)
        if len(idle):
            none = np.zeros(len(idle), int)
            yield _event_frame(names, idle, none + 1, state["gone"][idle], none + np.nan, none + np.nan, none, none)


def _event_frame(names, listing, kind, at, old_price, new_price, old_status, new_status) -> pd.DataFrame:
    stated = np.array([*STATED, "relisted"], dtype=object)
    return pd.DataFrame({
        "source": names[0][listing], "external_id": names[1][listing], "event_type": KINDS[kind], "occurred_at": at.astype("datetime64[us]"),
        "old_price": old_price, "new_price": new_price, "old_status": stated[old_status], "new_status": stated[new_status],
    })


def _frame(events: list[tuple]) -> pd.DataFrame:
    names = [part.split()[0] for part in CHANGE_SCHEMA.split(", ")]
    return pd.DataFrame(events, columns=names)


def stream_changes(obs: DataFrame, idle_hours: int = 72, delay: str = "1 day") -> DataFrame:
    """Change events of an observation stream, with vanish timers.

    State is one small row per listing. Keep micro-batches bounded at the source
    (maxFilesPerTrigger / maxBytesPerTrigger): the cards of one listing in one micro-batch
    are sorted in memory.
    """
    cards = obs.select(*KEY, *CARD_FIELDS).withWatermark("seen_at", delay)
    return cards.groupBy(*KEY).transformWithStateInPandas(
        statefulProcessor=change_processor(idle_hours), outputStructType=CHANGE_SCHEMA,
        outputMode="Append", timeMode="EventTime",
    )


def stream_ordered_changes(
    obs: DataFrame, idle_hours: int = 72, delay: str = "1 day", span_seconds: int = 60, buckets: int = BUCKETS,
) -> DataFrame:
    """Change events of cards that may come up to ``delay`` late: those of the batch run, for any order of arrival.

    A card counts once the watermark has passed the end of its span of ``span_seconds``; a card behind the watermark is
    dropped by Spark. State is kept by ``buckets`` of listings, in RocksDB: one row per listing and the waiting cards, as columns. A bucket that fills a micro-batch
    is read batch by batch, so choose the span for the cards one bucket may have in it. The session runs in UTC.
    """
    cards = obs.select(*KEY, *CARD_FIELDS).withWatermark("seen_at", delay)
    return cards.withColumn("bucket", F.pmod(F.xxhash64(*KEY), F.lit(buckets))).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=_OrderedDetector(idle_hours, span_seconds), outputStructType=CHANGE_SCHEMA,
        outputMode="Append", timeMode="EventTime",
    )


def stream_activity(events: DataFrame, window: str = "1 day", slide: str | None = None, delay: str = "1 day",
                    time: str = "occurred_at", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Event counts per tumbling or sliding window; partial counts before the shuffle."""
    frame = F.window(time, window, slide) if slide else F.window(time, window)
    return (
        events.withWatermark(time, delay).groupBy(frame.alias("span"), *by).agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("span.start").alias("start"), F.col("span.end").alias("end"), *by, "n")
    )


def open_activity(events: DataFrame, window: str = "1 day", slide: str | None = None, delay: str = "1 day",
                  time: str = "occurred_at", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """The counts `stream_activity` still holds back: windows that end after the newest event less ``delay``.

    A batch count over the newest part of the log; with the closed windows of the stream it
    covers every event.
    """
    newest = events.agg(F.max(time)).first()[0]
    mark = F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {delay}")
    recent = events.where(F.col(time) > mark - F.expr(f"INTERVAL {window}"))
    frame = F.window(time, window, slide) if slide else F.window(time, window)
    return (
        recent.groupBy(frame.alias("span"), *by).agg(F.count(F.lit(1)).alias("n")).where(F.col("span.end") > mark)
        .select(F.col("span.start").alias("start"), F.col("span.end").alias("end"), *by, "n")
    )


def stream_mart(spark: SparkSession, root: str, parts: int = PARTS) -> VersionedTables:
    """The tables that `mart_writer` keeps."""
    return VersionedTables(spark, root, {"listings": KEY}, parts)


def mart_writer(
    spark: SparkSession, root: str, prepare: Callable[[DataFrame], DataFrame] | None = None, hot_rows: int = HOT_ROWS, parts: int = PARTS,
) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: merges a micro-batch of cards into the listing table.

    Every card counts: each one is compared with the state the one before left, whether that is
    stored or in the same micro-batch, so listings and events don't depend on where the source cuts its
    batches, as long as a listing's cards come in time order over batches. ``prepare`` cleans the cards first
    (`operators.state.clean_cards`). Only the parts of the table that the cards fall into are read and written; listings and events
    become visible together, by one manifest, and a repeated batch changes nothing (`sources.versions`).
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        mart = stream_mart(batch.sparkSession, root, parts)
        cards = stored(prepare(batch) if prepare else batch, "cards")
        touched = mart.touched("listings", cards)
        old = mart.read("listings", touched, before=batch_id)
        tracked = stored(track_cards(old, cards, hot_rows), "tracked")
        listings = next_listings(merge_state(old, fold_cards(cards, tracked)))
        events = mart_events(change_events(tracked))
        mart.commit(batch_id, {"listings": (listings, touched)}, {"events": events})

    return merge


def stream_to_mart(
    obs: DataFrame, root: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None,
    hot_rows: int = HOT_ROWS, parts: int = PARTS,
) -> StreamingQuery:
    """Idempotent mart update per micro-batch."""
    writer = mart_writer(obs.sparkSession, root, prepare, hot_rows, parts)
    return (
        obs.writeStream.foreachBatch(writer).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def change_writer(root: str, idle_hours: int = 72, delay: str = "1 DAY", hot_rows: int = HOT_ROWS) -> Callable[[DataFrame, int], None]:
    """foreachBatch twin of `stream_changes` for logs in which one listing may fill a micro-batch.

    The last known card of every listing is kept in two alternating slots and joins the
    micro-batch as its earliest row; the batch operators then track the changes, hot
    listings split over time. Cards of a listing are expected in time order over batches.
    """
    def slot(batch_id: int) -> str:
        return f"{root}/cards/slot={batch_id % 2}"

    def merge(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        fresh = batch.select(*KEY, *STICKY, "seen_at", "seq").withColumns({"gone": F.lit(False), "seed": F.lit(False)})
        rows = fresh
        if batch_id > 0:
            kept = session.read.schema(fresh.drop("seed").schema).parquet(slot(batch_id - 1))
            rows = kept.withColumn("seed", F.lit(True)).unionByName(fresh)
        tracked = track_observations(rows.withColumn("reported", F.col("gone")), idle_hours=idle_hours, hot_rows=hot_rows, also=["reported"])
        tracked = stored(tracked.where(~F.col("seed")), "tracked")
        position = F.struct("seen_at", "seq")
        cards = rows.groupBy(*KEY).agg(
            *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), position)).alias(c) for c in STICKY],
            F.max("seen_at").alias("seen_at"), F.max_by("seq", position).alias("seq"), F.max_by("gone", position).alias("gone"),
        )
        newest = cards.agg(F.max("seen_at")).first()[0]
        due = F.col("seen_at") + F.expr(f"INTERVAL {idle_hours} HOURS")
        late = (map_status(F.col("source_status_raw")) == "active") & ~F.col("gone") & (
            due < F.lit(newest) - F.expr(f"INTERVAL {delay}"))
        cards.withColumn("late", late).withColumn("gone", F.col("gone") | F.col("late")).write.mode("overwrite").parquet(slot(batch_id))
        after = session.read.parquet(slot(batch_id))
        changes = change_events(tracked).select(
            *KEY, "event_type", "occurred_at", *[f"payload.{c}" for c in ("old_price", "new_price", "old_status", "new_status")])
        gaps = tracked.where((F.col("stored_status") == "vanished") & (F.col("prev_mapped") == "active") & ~F.col("prev_reported"))
        ends = after.where("late").select(*KEY, due.alias("occurred_at"))
        gone = gaps.select(*KEY, F.col("stored_vanished_at").alias("occurred_at")).unionByName(ends).withColumn("event_type", F.lit("vanished"))
        changes.unionByName(gone, allowMissingColumns=True).write.mode("overwrite").parquet(f"{root}/events/batch={batch_id}")

    return merge


def stream_changes_by_batch(obs: DataFrame, root: str, checkpoint: str, idle_hours: int = 72, delay: str = "1 DAY") -> StreamingQuery:
    """Runs `change_writer` over all available input."""
    return (
        obs.writeStream.foreachBatch(change_writer(root, idle_hours, delay)).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def run_available(df: DataFrame, name: str) -> DataFrame:
    """Runs a stream over all available input into the shared folder and reads the result."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    out = scratch(spark, name)
    query = (
        df.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, f"{name}-cp"))
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)
