"""Reads of the evidence store: tables of the event graph, pages of a claim's sources, events of a source, views of an event, audits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions.durable import durable
from ferrule.functions.keys import hash_key, prefixed
from ferrule.operators.graph import claim_pages, source_rank

#: Most events in a list, audit rows in a reply, related URLs and supporting sources of an event, and the form of a claim's id.
MOST_EVENTS, MOST_AUDITS, MOST_RELATED, CLAIM_ID = 100, 500, 20, "^clm_[0-9a-f]{64}$"


@dataclass(frozen=True)
class EventTables:
    """observations: observation_id, observation_key, source_id, tier, record_id, canonical_url, title, published_at.
    events: event_id, issuer, event_key, published_at. links: event_id, observation_id, rank. claims: event_id, claim_id.
    claim_sources: relation_id, claim_id, observation_id, source_reference_id."""

    observations: DataFrame
    events: DataFrame
    links: DataFrame
    claims: DataFrame
    claim_sources: DataFrame


def event_tables(seen: DataFrame) -> EventTables:
    """The tables of observations() grouped by exact keys. An observation is that of its first arrival, an event that of its first observation's;
    a relation between a claim and a source has the number of its first arrival, so numbers grow as relations come. All tables are made from one durable copy of seen,
    and links once for those that read them, so texts are read and normalised once."""
    kept = ("issuer", "source_id", "tier", "record_id", "canonical_url", "title", "published_at", "arrival", "observation_key", "event_key")
    seen = durable(seen.select(*kept))
    first = lambda *names: [F.min_by(n, "arrival").alias(n) for n in names]
    observations = seen.groupBy("observation_key").agg(F.min("arrival").alias("observation_id"), *first("source_id", "tier", "record_id", "canonical_url", "title", "published_at"))
    events = seen.groupBy("event_key", "issuer").agg(F.min("arrival").alias("event_id"), *first("published_at"))
    linked = seen.groupBy("event_key", "issuer", "observation_key").agg(F.min("arrival").alias("relation_id"), F.max(source_rank(F.col("tier"))).alias("rank"))
    linked = linked.join(events.select("event_key", "issuer", "event_id"), ["event_key", "issuer"]).join(observations.select("observation_key", "observation_id"), "observation_key")
    linked = durable(linked.select("event_id", "observation_id", "observation_key", "relation_id", "rank"))
    claims = missing_claims(events, None)
    sources = linked.join(claims, "event_id").select("relation_id", "claim_id", "observation_id", prefixed("src_", "observation_key").alias("source_reference_id"))
    return EventTables(observations, events, linked.select("event_id", "observation_id", "rank"), claims, sources)


def missing_claims(events: DataFrame, claims: DataFrame | None) -> DataFrame:
    """(event_id, claim_id) of events that have no claim yet; a claim's id never changes, as it comes from its event's key."""
    left = events if claims is None else events.join(claims, "event_id", "left_anti")
    return left.select("event_id", prefixed("clm_", "issuer", "event_key").alias("claim_id"))


def checked_claims(asked: DataFrame, claims: DataFrame) -> DataFrame:
    """asked (claim_id, cursor, limit) with error: invalid_claim_id, invalid_cursor, invalid_limit, unknown_claim, or null."""
    known = claims.select("claim_id", F.lit(True).alias("_known")).distinct()
    wrong = (
        F.when(~F.coalesce(F.col("claim_id").rlike(CLAIM_ID), F.lit(False)), "invalid_claim_id").when(F.col("cursor") < 0, "invalid_cursor")
        .when(~F.col("limit").between(1, 20), "invalid_limit").when(F.col("_known").isNull(), "unknown_claim")
    )
    return asked.join(known, "claim_id", "left").withColumn("error", wrong).drop("_known")


def source_pages(tables: EventTables, size: int) -> DataFrame:
    """Every claim's sources in keyset pages of size, with total_sources, source_ids and tiers of the whole claim."""
    rows = tables.claim_sources.join(tables.observations.select("observation_id", "source_id", "tier", "canonical_url"), "observation_id")
    whole = rows.groupBy("claim_id").agg(F.count("*").alias("total_sources"), F.array_sort(F.collect_set("source_id")).alias("source_ids"), F.array_sort(F.collect_set("tier")).alias("tiers"))
    return claim_pages(rows, "claim_id", "relation_id", size).join(whole, "claim_id")


def newest(events: DataFrame, *by: str, most: int = MOST_EVENTS) -> DataFrame:
    """The newest events of each of by, the larger id first among equals, with their place."""
    order = Window.partitionBy(*by).orderBy(F.col("published_at").desc(), F.col("event_id").desc())
    return events.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def events_of_sources(tables: EventTables, since: Column, most: int = MOST_EVENTS) -> DataFrame:
    """(issuer, source_id, event_id, published_at, place): the newest events that each source saw of each issuer."""
    seen = tables.links.join(tables.observations.select("observation_id", "source_id"), "observation_id").select("event_id", "source_id").distinct()
    recent = tables.events.where(F.col("published_at") >= since).select("event_id", "issuer", "published_at")
    return newest(recent.join(seen, "event_id"), "issuer", "source_id", most=most)


def titles_of_sources(tables: EventTables, since: Column, most: int = MOST_AUDITS) -> DataFrame:
    """(issuer, source_id, title, published_at, place): stored titles of each source, newest event first, then by observation."""
    recent = tables.events.where(F.col("published_at") >= since).select("event_id", "issuer", F.col("published_at").alias("event_at"))
    rows = recent.join(tables.links, "event_id").join(tables.observations.select("observation_id", "source_id", "title", "published_at"), "observation_id")
    order = Window.partitionBy("issuer", "source_id").orderBy(F.col("event_at").desc(), F.col("event_id").desc(), "observation_id")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("issuer", "source_id", "observation_id", "title", "published_at", "place")


def event_views(tables: EventTables, source_id: str | None = None, fits: Column | None = None) -> DataFrame:
    """One row per event: event_id, issuer, claim_id, primary_id, primary_source, related_urls, source_count, tiers, supporting_ids, truncated.

    The primary observation has the highest rank, then the smallest id. With source_id the view is that source's: its first observation
    whose title fits, and events without one have no view; its other observations that don't fit aren't related. fits: a
    condition on title and published_at. Related are the other observations, by rank, then id, at most MOST_RELATED.
    """
    rows = tables.links.join(tables.observations, "observation_id").withColumn("_fits", F.lit(True) if fits is None else F.coalesce(fits, F.lit(False)))
    of_source = F.lit(True) if source_id is None else F.col("source_id") == source_id
    order = F.struct(-F.col("rank"), F.col("observation_id")) if source_id is None else F.struct(F.col("observation_id"))
    hidden = of_source & ~F.col("_fits") & F.lit(source_id is not None)
    found = rows.groupBy("event_id").agg(
        F.min_by("observation_id", F.when(of_source & F.col("_fits"), order)).alias("primary_id"),
        F.min_by("source_id", F.when(of_source & F.col("_fits"), order)).alias("primary_source"),
        F.array_sort(F.collect_set("tier")).alias("tiers"),
    )
    entry = F.struct((-F.col("rank")).alias("rank"), "observation_id", "canonical_url")
    others = _first_of(rows.where(~hidden), "event_id", entry, MOST_RELATED + 1).withColumnRenamed("first", "_others")  # the primary may be among them
    ids = _first_of(tables.claim_sources, "claim_id", F.struct("relation_id", "source_reference_id"), MOST_RELATED).withColumnRenamed("first", "_support")
    support = tables.claim_sources.groupBy("claim_id").agg(F.count("*").alias("source_count")).join(ids, "claim_id")
    related = F.transform(F.slice(F.filter("_others", lambda e: e["observation_id"] != F.col("primary_id")), 1, MOST_RELATED), lambda e: e["canonical_url"])
    viewed = found.where("primary_id is not null").join(others, "event_id").withColumn("related_urls", related).drop("_others")
    viewed = viewed.join(tables.events.select("event_id", "issuer"), "event_id").join(tables.claims, "event_id").join(support, "claim_id")
    supporting = F.transform("_support", lambda s: s["source_reference_id"])
    return viewed.withColumn("supporting_ids", supporting).withColumn("truncated", F.col("source_count") > MOST_RELATED).drop("_support")


def _first_of(rows: DataFrame, key: str, entry: Column, most: int) -> DataFrame:
    """(key, first): the least entries of each key in order. Tasks keep no more of a key than most before rows are shuffled, so a hot key leaves few."""
    placed = rows.select(key, entry.alias("_e")).withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_e")))
    return placed.where(F.col("_n") <= most).groupBy(key).agg(F.array_sort(F.collect_list("_e")).alias("first"))


def audits(rows: DataFrame, issuer: str | None = None, since: Column | None = None, accepted: bool | None = None, most: int = MOST_AUDITS, ident: str = "id") -> DataFrame:
    """The first audit rows by id of each issuer under whichever of these conditions are given, with their place."""
    if not 1 <= most <= MOST_AUDITS:
        raise ValueError("limit must be 1 to 500")
    for wanted in (None if issuer is None else F.col("issuer") == issuer, None if since is None else F.col("observed_at") >= since, None if accepted is None else F.col("accepted") == accepted):
        rows = rows if wanted is None else rows.where(wanted)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("issuer").orderBy(ident))).where(F.col("place") <= most)


def grouped_claims(evidence: DataFrame) -> DataFrame:
    """(evidence_id, title, claim_id, source_count, corroborating, supporting_ids, truncated) of evidence that groups two complete sources or more.

    evidence: evidence_id, issuer, sources, an array of (source_id, record_id, canonical_url, complete). The group's title is a hash of its sorted records; explicit
    grouping ties all sources to the event of the first, whatever their titles and times. Sources that repeat count once.
    """
    sources = F.col("sources")
    title = F.concat(F.lit("sec-ownership-group-"), F.sha2(F.array_join(F.array_sort(F.transform(sources, lambda s: s["record_id"])), "\x1f"), 256))
    whole = evidence.where((F.size(sources) >= 2) & ~F.exists(sources, lambda s: ~F.coalesce(s["complete"], F.lit(False))))
    named = whole.withColumn("title", title).withColumn("_title", F.replace("title", F.lit("-"), F.lit(" ")))
    first = F.element_at(sources, 1)
    named = named.withColumn("claim_id", prefixed("clm_", "issuer", hash_key("issuer", "_title", first["canonical_url"])))
    reference = lambda s: prefixed("src_", hash_key(s["source_id"], s["record_id"], s["canonical_url"], F.col("_title")))
    ids = F.array_distinct(F.transform(sources, reference))
    return named.select(
        "evidence_id", "title", "claim_id", F.size(ids).alias("source_count"), F.greatest(F.size(ids) - 1, F.lit(0)).alias("corroborating"),
        F.slice(ids, 1, MOST_RELATED).alias("supporting_ids"), (F.size(ids) > MOST_RELATED).alias("truncated"),
    )
