"""Canonical events of observations: exact keys, near titles within two days, corrections, primary sources and claims."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.functions.durable import durable
from ferrule.functions.joins import numbered, unused
from ferrule.functions.keys import hash_key, prefixed
from ferrule.functions.text import normalize_title, token_set_ratio
from ferrule.functions.urls import canonical_url
from ferrule.operators.near_titles import NEAR_HOURS, NEAR_RATIO, Wording, announced, title_pairs

#: Ranks of source tiers.
SOURCE_RANKS = {"primary_regulator": 100, "issuer_primary": 95, "authorized_vendor": 80, "discovery": 50}
OTHER_RANK = 10
#: Spans of time are counted from here.
EPOCH = datetime(1970, 1, 1)


def source_rank(tier: Column) -> Column:
    found = F.lit(OTHER_RANK)
    for name, rank in SOURCE_RANKS.items():
        found = F.when(tier == name, rank).otherwise(found)
    return found


def observations(rows: DataFrame) -> DataFrame:
    """rows (issuer, source_id, record_id, tier, url, title, published_at, arrival) with canonical_url, normal_title and keys; rows without either go.

    arrival is a total order. One article of two issuers is one observation, that of the first arrival, and two events.
    """
    # as a generator's output both are computed once; a condition on columns would move below them, with a second copy of their work
    both = F.array(F.struct(canonical_url(F.col("url")).alias("canonical_url"), normalize_title(F.col("title")).alias("normal_title")))
    found = rows.select("*", F.inline_outer(both)).where("canonical_url is not null and normal_title <> ''")
    return found.withColumn("observation_key", hash_key("source_id", "record_id", "canonical_url", "normal_title")).withColumn("event_key", hash_key("issuer", "normal_title", "canonical_url"))


def exact_events(seen: DataFrame) -> DataFrame:
    """(event_key, issuer, sources, primary_key, first_arrival, claim_id): events by exact key, their distinct observations and primary source.

    The primary source has the highest rank, then the earliest observation. An event's observations are first reduced to one row each.
    """
    first = seen.groupBy("observation_key").agg(F.min("arrival").alias("observation_id"))
    linked = seen.groupBy("event_key", "issuer", "observation_key").agg(F.max(source_rank(F.col("tier"))).alias("rank"), F.min("arrival").alias("arrival"))
    linked = linked.join(first, "observation_key")
    order = F.struct(-F.col("rank"), F.col("observation_id"))
    found = linked.groupBy("event_key", "issuer").agg(F.count("*").alias("sources"), F.min_by("observation_key", order).alias("primary_key"), F.min("arrival").alias("first_arrival"))
    return found.withColumn("claim_id", prefixed("clm_", "issuer", "event_key"))


FOLDED = "issuer string, arrival long, event_id long, version int, correction_of long, exact boolean"


class Events:
    """Events of one issuer by exact key and by span of time."""

    def __init__(self):
        self.keys: dict[str, dict] = {}
        self.spans: dict[int, list[dict]] = {}

    def with_key(self, key: str) -> dict | None:
        return self.keys.get(key)

    def within(self, span: int) -> list[dict]:
        return self.spans.get(span, [])

    def add(self, event: dict) -> None:
        self.keys[event["event_key"]] = event
        self.spans.setdefault(span_of(event["published_at"]), []).append(event)


def span_of(time) -> int:
    return int((time - EPOCH).total_seconds() // (NEAR_HOURS * 3600))


def fold_events(rows, events=None):
    """Assign observations of one issuer, in order of arrival, to events; rows and the result are lists of dicts.

    An observation joins the event with its exact key; else the event published within NEAR_HOURS whose title is nearest,
    at NEAR_RATIO or more, the smallest event among equals. An event keeps its first title and time. A title that announces
    a correction, or has other numbers under like words, opens the next version of that event instead. events are
    earlier ones, to which new ones are added. An event's id is the arrival of its first observation.
    """
    events, out = Events() if events is None else events, []
    for r in sorted(rows, key=lambda r: r["arrival"]):
        event, earlier = events.with_key(r["event_key"]), None
        exact = event is not None
        if not exact:
            span = span_of(r["published_at"])
            event = nearest(r, [e for s in (span - 1, span, span + 1) for e in events.within(s)])
            if event is not None and Wording.of(r["normal_title"]).corrects(Wording.of(event["normal_title"])):
                event, earlier = None, event
            if event is None:
                version = earlier["version"] + 1 if earlier else 1
                event = {k: r[k] for k in ("event_key", "normal_title", "published_at")} | {"event_id": r["arrival"], "version": version, "correction_of": earlier and earlier["event_id"]}
                events.add(event)
        out.append({"issuer": r["issuer"], "arrival": r["arrival"], "event_id": event["event_id"], "version": event["version"], "correction_of": event["correction_of"], "exact": exact})
    return out


def nearest(row: dict, events: list[dict]) -> dict | None:
    """The event within NEAR_HOURS with the most similar title, at NEAR_RATIO or more; the smallest id among equals."""
    rated = [(token_set_ratio(row["normal_title"], e["normal_title"], NEAR_RATIO), -e["event_id"], e) for e in events if abs((e["published_at"] - row["published_at"]).total_seconds()) <= NEAR_HOURS * 3600]
    ratio, _, event = max(rated, key=lambda x: x[:2], default=(0.0, 0, None))
    return event if ratio >= NEAR_RATIO else None


#: Rows, of observations and of what they may join, that are few enough for one task to finish.
LAST_ROWS = 100_000
#: Microseconds of a span of time.
SPAN = NEAR_HOURS * 3600 * 1_000_000


def near_events(seen: DataFrame, last_rows: int = LAST_ROWS) -> DataFrame:
    """(issuer, arrival, event_id, version, correction_of, exact) of each observation, as folded in order of arrival.

    Titles meet by title_pairs, and which observations open events is found by founders(). With these known, each observation
    finds its event at once: that of its exact key, else the nearest earlier one. No issuer, title or key is one task's work; see founders() for last_rows.
    arrival is unique. An empty table gives no rows.
    """
    rows = durable(_spanned(seen))
    near = durable(_alike(rows))
    found = founders(rows, near, last_rows)
    own = rows.join(found.select(F.col("event_key"), F.col("event_id").alias("_own")), "event_key", "left")
    exact = own.where("_own < arrival").select("issuer", "arrival", F.col("_own").alias("event_id"), F.lit(True).alias("exact"))
    rest = durable(own.where("_own is null or _own >= arrival").select("issuer", "arrival", "key", "span", "at", F.col("_own").eqNullSafe(F.col("arrival")).alias("opens")))
    nearest_of = _best(rest, near, found).select("issuer", "arrival", F.col("best.event_id").alias("near"))
    placed = durable(rest.join(nearest_of, ["issuer", "arrival"], "left"))
    events = _versions(placed.where("opens").select(F.col("arrival").alias("event_id"), F.col("near").alias("correction_of")))
    fuzzy = placed.select("issuer", "arrival", F.when(F.col("opens"), F.col("arrival")).otherwise(F.col("near")).alias("event_id"), F.lit(False).alias("exact"))
    return fuzzy.unionByName(exact).join(events, "event_id").select("issuer", "arrival", "event_id", "version", "correction_of", "exact")


def _spanned(seen: DataFrame) -> DataFrame:
    at = F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), F.col("published_at").cast("timestamp_ntz"))
    named = seen.select("issuer", "arrival", "event_key", F.col("normal_title").alias("title"), F.sha2(F.concat_ws("\x1f", "issuer", "normal_title"), 256).alias("key"), at.alias("at"))
    return named.withColumn("span", F.floor(F.col("at") / SPAN)).withColumn("announced", announced("title"))


def _alike(rows: DataFrame) -> DataFrame:
    """(key, other, ratio, corrects): titles that are alike, each with itself too; corrects: whether the title of key, coming after other, opens a version."""
    pairs = title_pairs(rows.select("issuer", "key", "title", "span").distinct())
    same = rows.select("key", "announced").distinct()
    same = same.select("key", F.col("key").alias("other"), F.lit(100.0).alias("ratio"), F.col("announced").alias("corrects"))
    return same.unionByName(pairs.select(F.col("b").alias("key"), F.col("a").alias("other"), "ratio", "corrects"))


def _within(near: DataFrame, found: DataFrame) -> DataFrame:
    """(key, span, e_at, event_id, ratio, corrects): events that observations of a title may join, in each span that they reach."""
    events = found.select(F.col("key").alias("other"), F.explode(F.array(F.col("span") - 1, F.col("span"), F.col("span") + 1)).alias("span"), F.col("at").alias("e_at"), "event_id")
    # of events of one title and time, only the first is ever the nearest
    first = events.groupBy("other", "span", "e_at").agg(F.min("event_id").alias("event_id"))
    return near.join(first, "other").drop("other")


def _best(rows: DataFrame, near: DataFrame, found: DataFrame) -> DataFrame:
    """(issuer, arrival, best, whole) of rows that have earlier events near: the most similar, the first among equals, and the first of those fully alike."""
    met = rows.select("issuer", "arrival", "key", "span", "at").join(_within(near, found), ["key", "span"])
    met = met.where((F.abs(F.col("at") - F.col("e_at")) <= SPAN) & (F.col("event_id") < F.col("arrival")))
    event = F.struct("event_id", "corrects")
    return met.groupBy("issuer", "arrival").agg(
        F.max_by(event, F.struct("ratio", -F.col("event_id"))).alias("best"), F.min(F.when(F.col("ratio") == 100, event)).alias("whole")
    )


def founders(rows: DataFrame, near: DataFrame, last_rows: int = LAST_ROWS) -> DataFrame:
    """(event_id, event_key, key, span, at) of the observations that open events, found in rounds.

    A title that announces a correction opens an event with the first observation of each exact key, whatever came before. Of the others an observation is settled
    in a round once nothing undecided can change what becomes of it:
    - an event has its exact key;
    - it has an earlier event near, and no title alike can make it a correction of one;
    - an event near is fully alike and older than all undecided observations of titles alike around: nothing is nearer;
    - it is the first undecided one of all titles alike around, and of its key.
    So a title that a third of all rows carry takes a round for each span of time that it lasts, whatever its rows. Once undecided rows and what they may join are
    last_rows at most, they are numbers that one task folds in order of arrival; rounds would end with the same.
    """
    plain = ["event_id", "event_key", "key", "span", "at"]
    opening = rows.where("announced").groupBy("event_key").agg(F.min_by(F.struct(F.col("arrival").alias("event_id"), "key", "span", "at"), "arrival").alias("e"))
    found = durable(opening.select("event_key", "e.*").select(*plain))
    left = durable(rows.where("not announced").select("issuer", "arrival", "event_key", "key", "span", "at"))
    changing = near.where("corrects").select("key").distinct().withColumn("changes", F.lit(True))
    while True:
        left = durable(left.join(found.select("event_key"), "event_key", "left_anti"))
        count = left.count()
        if not count:
            return found
        if count <= last_rows and (held := _open_choices(left, near, found, last_rows - count)) is not None:
            return durable(found.unionByName(_last(left, held).select(*plain)))
        heads = left.groupBy("key", "span").agg(F.min("arrival").alias("head"))
        around = heads.select(F.col("key").alias("other"), F.explode(F.array(F.col("span") - 1, F.col("span"), F.col("span") + 1)).alias("span"), "head").join(near.select("key", "other"), "other")
        first = around.groupBy("key", "span").agg(F.min("head").alias("first"))
        first_of_key = left.groupBy("event_key").agg(F.min("arrival").alias("first_of_key"))
        judged = left.join(first, ["key", "span"]).join(first_of_key, "event_key").join(changing, "key", "left").join(_best(left, near, found), ["issuer", "arrival"], "left")
        head = F.col("arrival") == F.col("first")
        whole = F.col("whole.event_id") < F.col("first")
        corrects = F.when(whole, F.col("whole.corrects")).when(head, F.coalesce("best.corrects", F.lit(True)))
        joins = (~corrects) | (F.col("best").isNotNull() & F.col("changes").isNull())
        opens = corrects & (F.col("arrival") == F.col("first_of_key"))
        state = F.when(F.coalesce(joins, F.lit(False)), "joins").when(F.coalesce(opens, F.lit(False)), "opens").otherwise("waits")
        judged = durable(judged.select("issuer", "arrival", "event_key", "key", "span", "at", state.alias("state")))
        found = durable(found.unionByName(judged.where("state = 'opens'").withColumnRenamed("arrival", "event_id").select(*plain)))
        left = judged.where("state = 'waits'").drop("state")


def _open_choices(left: DataFrame, near: DataFrame, found: DataFrame, most: int) -> DataFrame | None:
    """(issuer, key, other, ratio, corrects, events) for titles of left: titles alike that are undecided too or have events around, if no more than most. events are arrays of (at, event_id)."""
    titles = left.select("issuer", "key").distinct()
    spans = left.select("key", F.explode(F.array(F.col("span") - 1, F.col("span"), F.col("span") + 1)).alias("span")).distinct()
    alike = near.join(titles, "key")
    reached = alike.select("issuer", "other").join(found.withColumnRenamed("key", "other"), "other").join(spans.join(near.select("key", "other"), "key").select("other", "span").distinct(), ["other", "span"])
    reached = durable(reached.select("issuer", "other", "at", "event_id").distinct())
    if reached.count() + alike.count() > most:
        return None
    events = reached.groupBy("issuer", "other").agg(F.collect_list(F.struct("at", "event_id")).alias("events"))
    return durable(alike.join(events, ["issuer", "other"], "left").select("issuer", "key", "other", "ratio", "corrects", "events"))


def _last(left: DataFrame, choices: DataFrame) -> DataFrame:
    """The observations of left that open events, folded in order of arrival, an issuer at a time; both frames are small."""

    def fold(left, choices):
        import pandas as pd

        alike: dict = {}
        events: dict = {}
        for key, other, ratio, corrects, known in zip(choices["key"], choices["other"], choices["ratio"], choices["corrects"], choices["events"]):
            alike.setdefault(key, []).append((ratio, other, corrects))
            events.setdefault(other, [(e["at"], e["event_id"]) for e in known] if known is not None else [])
        opened: list = []
        keys: set = set()
        for r in left.sort_values("arrival").itertuples():
            if r.event_key in keys:
                continue
            met = [(ratio, -e, corrects) for ratio, other, corrects in alike[r.key] for at, e in events.get(other, ()) if abs(at - r.at) <= SPAN and e < r.arrival]
            if not met or max(met)[2]:
                opened.append(r.Index)
                keys.add(r.event_key)
                events.setdefault(r.key, []).append((r.at, r.arrival))
        return left.loc[opened].rename(columns={"arrival": "event_id"})[["event_id", "event_key", "key", "span", "at"]]

    return left.groupBy("issuer").cogroup(choices.groupBy("issuer")).applyInPandas(fold, "event_id long, event_key string, key string, span long, at long")


def _versions(events: DataFrame) -> DataFrame:
    """(event_id, correction_of, version): one more than the version of what an event corrects. Each round doubles how far back an event has looked."""
    now = events.withColumn("up", F.col("correction_of")).withColumn("version", F.when(F.col("up").isNotNull(), 2).otherwise(1))
    while True:
        now = durable(now)
        if now.where("up is not null").isEmpty():
            return now.select("event_id", "correction_of", "version")
        above = now.select(F.col("event_id").alias("up"), F.col("up").alias("further"), (F.col("version") - 1).alias("more"))
        now = now.join(above, "up", "left").select("event_id", "correction_of", F.col("further").alias("up"), (F.col("version") + F.coalesce("more", F.lit(0))).alias("version"))


def claim_pages(rows: DataFrame, key: str, order: str, size: int) -> DataFrame:
    """rows with page, from 1, and next_cursor, the last order of a page that another follows: keyset pages of every key at once.
    A key with a third of all rows is numbered by many tasks; order is unique within a key."""
    n, whole = unused(rows, "_n"), unused(rows, "_all")
    placed = numbered(rows, key, order, n, whole)
    page = F.floor((F.col(n) - 1) / size) + 1
    last = (F.col(n) % size == 0) & (F.col(n) < F.col(whole))
    return placed.withColumn("page", page.cast("long")).withColumn("next_cursor", F.when(last, F.col(order))).drop(n, whole)


def page_after(rows: DataFrame, claim: str, cursor: int, limit: int, order: str = "relation_id", key: str = "claim_id") -> DataFrame:
    """One page of one claim: rows after the cursor, one more than the limit if there is one, so that the caller knows."""
    if cursor < 0 or not 1 <= limit <= 20:
        raise ValueError("cursor must not be negative and limit must be 1 to 20")
    return rows.where((F.col(key) == claim) & (F.col(order) > cursor)).orderBy(order).limit(limit + 1)
