"""The batch operators on streams: attention by day, collector states, and the event graph with keyed state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ferrule.operators.graph import FOLDED, fold_events, span_of
from ferrule.operators.near_titles import NEAR_HOURS
from ferrule.sources import store

#: How late a post may come and still count.
LATENESS = "20 minutes"


def attention_stream(posts: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """(issuer, day, post_count) of each completed day: posts of issuer, uri, ts, each counted once."""
    once = posts.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["issuer", "uri"])
    days = once.groupBy(F.window("ts", "1 day"), "issuer").agg(F.count("*").alias("post_count"))
    return days.select("issuer", F.to_date("window.start").alias("day"), "post_count")


def states_to_table(states: DataFrame, path: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Merge a stream of collector states into a table, a version for each batch, so that a batch tried again writes the same version."""

    def merge(batch: DataFrame, number: int) -> None:
        if number not in store.versions(batch.sparkSession, path):
            latest = batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), "checked").alias("s")).select("s.*")
            store.upsert_state(latest, path, keys, number)

    return states.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def observations_to_table(seen: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Add a stream of observations to a table, each key once over all time. Several streams may add to one table; the checkpoint tells them apart."""

    def add(batch: DataFrame, number: int) -> None:
        store.append_new(batch, path, "observation_key", number, writer=checkpoint)

    return seen.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: How long before the newest published time of earlier batches an observation may be published and still count.
GRAPH_LATENESS = "7 days"
#: The state store that keeps a map's entries apart, so that one is read or written without the others.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SPAN_MS = NEAR_HOURS * 3600 * 1000
EVENT = "event_id long, title string, at timestamp_ntz, version int, correction_of long"


class _StoredEvents:
    """Events of an issuer in maps of its state: an entry for each exact key, and one for each event of a span. A span is read once a batch, when it is first met."""

    def __init__(self, keys, sizes, entries, expire):
        self.keys, self.sizes, self.entries, self.expire = keys, sizes, entries, expire
        self.spans: dict[int, list[dict]] = {}

    def with_key(self, key: str) -> dict | None:
        found = self.keys.getValue((key,)) if self.keys.containsKey((key,)) else None
        return None if found is None else {"event_key": key, "event_id": found[0], "version": found[1], "correction_of": found[2]}

    def within(self, span: int) -> list[dict]:
        if span not in self.spans:
            size = self.sizes.getValue((span,))[0] if self.sizes.containsKey((span,)) else 0
            names = ("event_id", "normal_title", "published_at", "version", "correction_of")
            self.spans[span] = [dict(zip(names, self.entries.getValue((span, n)))) for n in range(size)]
        return self.spans[span]

    def add(self, event: dict) -> None:
        span = span_of(event["published_at"])
        known = self.within(span)
        ids = (event["event_id"], event["version"], event["correction_of"])
        self.keys.updateValue((event["event_key"],), ids)
        self.entries.updateValue((span, len(known)), (ids[0], event["normal_title"], event["published_at"], *ids[1:]))
        known.append(event)
        self.sizes.updateValue((span,), (len(known),))
        self.expire(span)


class EventFold(StatefulProcessor):
    """Folds an issuer's observations of each batch; titles of a span go once nothing in time can come near them, exact keys stay."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.keys = handle.getMapState("keys", "event_key string", "event_id long, version int, correction_of long")
        self.sizes = handle.getMapState("sizes", "span long", "events int")
        self.entries = handle.getMapState("entries", "span long, place int", EVENT)

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        expire = lambda span: self.handle.registerTimer((span + 2) * SPAN_MS)
        events = _StoredEvents(self.keys, self.sizes, self.entries, expire)
        found = fold_events([r for frame in rows for r in frame.to_dict("records")], events)
        yield pd.DataFrame(found, columns=["issuer", "arrival", "event_id", "version", "correction_of", "exact"]).astype({"correction_of": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        span = expiredTimerInfo.getExpiryTimeInMs() // SPAN_MS - 2
        for place in range(self.sizes.getValue((span,))[0] if self.sizes.containsKey((span,)) else 0):
            self.entries.removeKey((span, place))
        if self.sizes.containsKey((span,)):
            self.sizes.removeKey((span,))
        yield from ()

    def close(self) -> None:
        pass


def graph_stream(seen: DataFrame, lateness: str = GRAPH_LATENESS) -> DataFrame:
    """Events of a stream of observations: issuer, arrival, event_key, normal_title, published_at; columns as near_events has them.

    Within a batch an issuer's observations are folded in order of arrival; batches must come in that order. A batch reads its exact keys and the spans of time that its observations may
    join, not the issuer's other events. What was published more than lateness before the newest of earlier batches is late and left out; a span's titles go
    twice NEAR_HOURS after its begin, once that is late. Exact keys stay, as one may come again at any time. Sets the session's state store to STATE_STORE.
    """
    seen.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    at = F.col("published_at").cast("timestamp_ntz")
    clock = F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), at))  # whatever the session's zone
    rows = seen.select("issuer", "arrival", "event_key", "normal_title", at.alias("published_at"), clock.alias("clock")).withWatermark("clock", lateness)
    return rows.groupBy("issuer").transformWithStateInPandas(EventFold(), outputStructType=FOLDED, outputMode="Append", timeMode="EventTime")
