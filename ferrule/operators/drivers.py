"""Collectors from tickers to evidence: who a ticker is, which of its filings are read, what their documents say, and what is said where something is missing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions.durable import durable
from ferrule.operators import documents
from ferrule.operators.collectors import filing_context
from ferrule.operators.signals import insider_clusters
from ferrule.sources import filings

#: Ownership forms, notices of proposed sales, most ownership documents of a ticker unless told otherwise, and the parser's version.
OWNERSHIP_FORMS, PROPOSED_FORMS, MOST_OWNERSHIP, PARSER_VERSION = ("3", "4", "5", "3/A", "4/A", "5/A"), ("144", "144/A"), 30, "sec-events-v1"
#: The statuses that a request ends with.
FRESH, NONE, UNSUPPORTED, UNAVAILABLE = "fresh", "no_observations", "unsupported", "unavailable"

WARNING = "ticker string, ordinal int, warning string"


@dataclass(frozen=True)
class Collected:
    """results: ticker, status, items. evidence: rows of its own for each collector. warnings: ticker, ordinal, warning, in order within a ticker.
    reasons: ticker, code, scope, scope_id, detail."""

    results: DataFrame
    evidence: DataFrame
    warnings: DataFrame
    reasons: DataFrame


def said(*parts) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def identified(asked: DataFrame, funds: DataFrame, known: DataFrame) -> DataFrame:
    """asked (ticker), each once, with cik and lane: fund, unresolved or company. funds: ticker. known: ticker, cik, one for each ticker."""
    reviewed = funds.select("ticker", F.lit(True).alias("_fund")).distinct()
    named = asked.select("ticker").distinct().join(reviewed, "ticker", "left").join(known.select("ticker", "cik"), "ticker", "left")
    lane = F.when(F.col("_fund"), "fund").when(F.col("cik").isNull(), "unresolved").otherwise("company")
    return named.select("ticker", "cik", lane.alias("lane"))


def _unresolved(lanes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The warning and the reason of tickers that nobody knows: not a quiet issuer, but an unidentified one."""
    lost = lanes.where("lane = 'unresolved'")
    warning = said("SEC has no CIK for ", F.col("ticker"), " in its mapping or company search.")
    return lost.select("ticker", F.lit(0).alias("ordinal"), warning.alias("warning")), lost.select("ticker", *_reason("entity_rejected", "evaluation", F.col("ticker"), "cik_unresolved"))


def _reason(code: str, scope: str, ident: Column, detail) -> list[Column]:
    return [F.lit(code).alias("code"), F.lit(scope).alias("scope"), ident.alias("scope_id"), (detail if isinstance(detail, Column) else F.lit(detail)).alias("detail")]


def _results(lanes: DataFrame, evidence: DataFrame) -> DataFrame:
    items = evidence.groupBy("ticker").agg(F.count("*").alias("items"))
    status = F.when(F.col("lane") == "fund", UNSUPPORTED).when(F.col("items") > 0, FRESH).otherwise(NONE)
    return lanes.join(items, "ticker", "left").select("ticker", status.alias("status"), F.coalesce("items", F.lit(0)).alias("items"))


def document_context(rows: DataFrame, landed: DataFrame) -> DataFrame:
    """rows (url, context, notes and others) with the context of their primary document in place of the items' where a rule speaks, and document_status,
    rule_id, parser_version.

    landed: url, html, one for each document that was fetched. document_status is the rules' (matched, ambiguous, no_match), or unavailable where the document is
    missing, empty or larger than MOST_DOCUMENT_BYTES; it is null for rows whose context is no other_material_event, which are not looked at. Novelty stays the row's.
    """
    body = documents.html_text(F.col("html"))
    read = landed.where((F.octet_length("html") <= documents.MOST_DOCUMENT_BYTES) & (F.trim("html") != ""))
    judged = documents.classify(read.select(F.col("url").alias("filing_id"), body.alias("text"))).withColumnRenamed("filing_id", "url")
    met = rows.join(judged.select("url", F.col("status").alias("_status"), F.col("rule_id").alias("_rule"), F.col("event_type").alias("_type")), "url", "left")
    asked = F.col("context.type") == "other_material_event"
    status = F.when(asked, F.coalesce("_status", F.lit(UNAVAILABLE)))
    rule = F.when(asked, F.col("_rule"))
    says = F.create_map(*(x for name, values in documents.RULE_CONTEXT.items() for x in (F.lit(name), F.struct(*(F.lit(v).alias(n) for n, v in zip(("label", "why", "materiality"), values))))))
    said_of = F.try_element_at(says, rule)
    context = F.when(rule.isNotNull(), F.col("context").withField("type", F.col("_type")).withField("label", said_of["label"]).withField("why", said_of["why"]).withField("materiality", said_of["materiality"]))
    notes = F.when(rule.isNotNull(), said(F.col("notes"), " ", said_of["label"], " identified by ", rule, f"@{documents.RULE_VERSION}."))
    version = F.when(rule.isNotNull(), f"{PARSER_VERSION}+{documents.RULESET_VERSION}").otherwise(PARSER_VERSION)
    kept = [c for c in rows.columns if c not in ("context", "notes")]
    return met.select(*kept, F.coalesce(context, F.col("context")).alias("context"), F.coalesce(notes, F.col("notes")).alias("notes"), status.alias("document_status"), rule.alias("rule_id"), version.alias("parser_version"))


def collect_filings(asked: DataFrame, funds: DataFrame, known: DataFrame, payloads: DataFrame, landed: DataFrame, indexes: DataFrame, cutoff: Column) -> Collected:
    """Tracked filings of the asked tickers as evidence.

    payloads: cik, payload of submissions. landed: url, html of primary documents. indexes: accession, payload of filing indexes. Funds are unsupported, as they have a
    lane of their own; a ticker without a company is rejected but counts as no_observations. Of the others, the first tracked filings of each payload are evidence: ticker, accession, form, ts, url,
    signal, direction, strength, context, notes, document_status, rule_id, parser_version, exhibits. An 8-K or 6-K that reports another material event is read, and its exhibits
    are listed; where either fails, a warning says so and the filing stays. Rows are joined by keys alone; a ticker has MOST_FILINGS filings at most.
    """
    lanes = identified(asked, funds, known)
    companies = lanes.where("lane = 'company'").select("ticker", "cik")
    listed = filings.filings(filings.submissions(payloads.join(companies.select("cik").distinct(), "cik", "left_semi")), cutoff)
    base = F.regexp_replace("form", "/A$", "")
    adverse = documents.adverse_signal(F.col("form"), F.col("items"))
    codes = F.array_join("items", ",")
    notes = F.when(F.size("items") > 0, said("SEC ", F.col("form"), " filing reports item codes ", codes, ".")).otherwise(said("SEC ", F.col("form"), " filing metadata."))
    rows = companies.join(listed, "cik").select(
        "ticker", "ordinal", "accession", "form", "ts", "url", F.coalesce(adverse, F.col("signal")).alias("signal"), F.when(adverse.isNotNull(), "bearish").otherwise("neutral").alias("direction"),
        "strength", filing_context(F.col("form"), F.col("items")).alias("context"), notes.alias("notes"), base.isin("8-K", "6-K").alias("_current"),
    )
    rows = durable(rows)
    # only current reports are read; what the others say stands in their form
    current = document_context(rows.where("_current"), landed.join(rows.where("_current").select("url").distinct(), "url", "left_semi"))
    others = rows.where("not _current").select("*", F.lit(None).cast("string").alias("document_status"), F.lit(None).cast("string").alias("rule_id"), F.lit(PARSER_VERSION).alias("parser_version"))
    index = indexes.select("accession", F.when(F.from_json("payload", filings.INDEX)["directory"].isNotNull(), filings.exhibits(F.col("payload"))).alias("_exhibits"))
    found = durable(current.unionByName(others).join(index, "accession", "left"))
    evidence = found.select(*(c for c in found.columns if c not in ("_current", "_exhibits")), F.when(F.col("_current"), F.col("_exhibits")).alias("exhibits"))
    unread = found.where("document_status = 'unavailable'").select("ticker", (F.col("ordinal") * 2 + 1).alias("ordinal"), said("SEC ", F.col("accession"), " primary document was unavailable or malformed.").alias("warning"))
    unlisted = found.where("_current and _exhibits is null").select("ticker", (F.col("ordinal") * 2 + 2).alias("ordinal"), said("SEC ", F.col("accession"), " exhibit index was unavailable or malformed.").alias("warning"))
    lost, rejected = _unresolved(lanes)
    skipped = lanes.where("lane = 'fund'")
    lane = skipped.select("ticker", F.lit(0).alias("ordinal"), said(F.col("ticker"), " uses the SEC fund lane; corporate filing semantics were skipped.").alias("warning"))
    quiet = companies.join(evidence.select("ticker").distinct(), "ticker", "left_anti").select("ticker", F.lit(0).alias("ordinal"), said("No tracked SEC filings found for ", F.col("ticker"), " in the lookback window.").alias("warning"))
    unsupported = skipped.select("ticker", *_reason("source_unsupported", "evaluation", F.col("ticker"), "fund_uses_distinct_sec_lane"))
    return Collected(_results(lanes, evidence), evidence.drop("ordinal"), unread.unionByName(unlisted).unionByName(lost).unionByName(lane).unionByName(quiet), unsupported.unionByName(rejected))


def planned_ownership(listed: DataFrame, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """Ownership filings to read, all of each company since the cutoff, and entries without a document. listed: submissions rows."""
    tracked = durable(listed.where(F.col("form").isin(*OWNERSHIP_FORMS, *PROPOSED_FORMS) & (F.col("ts") >= cutoff)))
    whole = (F.coalesce("accession", F.lit("")) != "") & (F.coalesce("document", F.lit("")) != "")
    return tracked.where(whole).withColumn("url", filings.archive_url(F.col("cik"), F.col("accession"), F.col("document"))), tracked.where(~whole)


def newest_ownership(planned: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The newest most filings of each company, and companies that had more, with how many. The order is by time, then accession, newest first, whatever the payload's order."""
    newest = Window.partitionBy("cik").orderBy(F.col("ts").desc(), F.col("accession").desc())
    kept = planned.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= most)
    return kept, planned.groupBy("cik").agg(F.count("*").alias("planned")).where(F.col("planned") > most)


def collect_insiders(asked: DataFrame, funds: DataFrame, known: DataFrame, payloads: DataFrame, landed: DataFrame, as_of: Column, lookback_days: int, most: int | None = MOST_OWNERSHIP) -> Collected:
    """Insiders' trades of the asked tickers: one signal of each, and a row for each notice of a proposed sale.

    payloads: cik, payload of submissions. landed: url, xml of ownership documents. evidence: ticker, signal, direction, strength, confidence, novelty, owners, net, source_count,
    latest, accession. Owners of a document count each for themselves. most: how many documents of a company are read, the newest; None reads them all. A company with more than most,
    or an entry without a document, gives a warning.
    """
    cutoff = as_of - F.make_dt_interval(F.lit(lookback_days))
    lanes = identified(asked, funds, known)
    companies = lanes.where("lane = 'company'").select("ticker", "cik")
    listed = filings.submissions(payloads.join(companies.select("cik").distinct(), "cik", "left_semi"))
    planned, bare = planned_ownership(listed, cutoff)
    over = None
    if most is not None:
        planned, over = newest_ownership(planned, most)
    read = planned.join(landed, "url")
    proposed = read.where(F.col("form").isin(*PROPOSED_FORMS)).join(companies, "cik")
    facts = filings.ownership(read.where(F.col("form").isin(*OWNERSHIP_FORMS)).select("url", "xml"))
    times = planned.select("url", "cik", F.col("ts").alias("filed")).distinct()
    owners = F.when(F.size(F.filter("owners", lambda o: o != "")) > 0, F.filter("owners", lambda o: o != "")).otherwise(F.array(F.lit("unknown reporting owner")))
    trades = facts.join(times, "url").join(companies, "cik").select(
        F.col("ticker").alias("issuer"), owners.alias("names"), "code", "acquired_disposed", "derivative", "planned", "shares", "price", F.coalesce("ts", "filed").alias("ts"), "url"
    )
    signals = insider_signals(trades, as_of, lookback_days)
    none = lambda kind: F.lit(None).cast(kind)
    cluster = signals.select(F.col("issuer").alias("ticker"), "signal", "direction", "strength", "confidence", "novelty", "owners", "net", "source_count", "latest", none("string").alias("accession"))
    notice = proposed.select(
        "ticker", F.lit("insider_proposed_sale").alias("signal"), F.lit("neutral").alias("direction"), none("double").alias("strength"), none("double").alias("confidence"), F.lit("new_event").alias("novelty"),
        none("int").alias("owners"), none("double").alias("net"), F.lit(1).alias("source_count"), F.col("ts").alias("latest"), "accession",
    )
    evidence = durable(cluster.unionByName(notice))
    omitted = bare.join(companies, "cik").select("ticker", F.col("ordinal").cast("int").alias("ordinal"), said("SEC ", F.col("form"), " entry omitted accession or primary document.").alias("warning"))
    quiet = companies.join(evidence.select("ticker").distinct(), "ticker", "left_anti").select("ticker", F.lit((1 << 31) - 1).alias("ordinal"), said("No qualifying direct SEC insider activity found for ", F.col("ticker"), ".").alias("warning"))
    lost, rejected = _unresolved(lanes)
    skipped = lanes.where("lane = 'fund'")
    lane = skipped.select("ticker", F.lit(0).alias("ordinal"), said(F.col("ticker"), " is a reviewed fund; corporate-insider semantics were skipped.").alias("warning"))
    unsupported = skipped.select("ticker", *_reason("source_unsupported", "family", F.lit("insider_trading"), "fund_has_no_corporate_insider_semantics"))
    warnings = omitted.unionByName(quiet).unionByName(lost).unionByName(lane)
    if over is not None:
        cut = said(f"SEC ownership filings truncated to the {most} most recent of ", F.col("planned").cast("string"), " in the lookback window.")
        warnings = warnings.unionByName(over.join(companies, "cik").select("ticker", F.lit((1 << 31) - 2).alias("ordinal"), cut.alias("warning")))
    return Collected(_results(lanes, evidence), evidence, warnings, unsupported.unionByName(rejected))


def insider_signals(trades: DataFrame, as_of: Column, lookback_days: int) -> DataFrame:
    """insider_clusters() of trades whose owners are arrays (names): a trade's value counts once, its owners each for themselves."""
    each = trades.select("*", F.posexplode("names").alias("_n", "owner"))
    return insider_clusters(each, as_of, lookback_days, F.col("_n") == 0)


def collect_funds(asked: DataFrame, identities: DataFrame, payloads: DataFrame, landed: DataFrame, cutoff: Column) -> Collected:
    """Reports of the asked funds.

    identities: ticker, identity_status, cik, series, class, the reviewed funds. A ticker that is none has no observations and nothing is said; one whose identity is not official_series_class is
    unsupported and none of its filings is looked at. payloads: cik, payload_cik, payload of submissions; landed: url, xml. A filing whose document is missing or not what it should be gives a warning and a
    reason for the candidate. Status: fresh with evidence, unavailable if all filings failed, else no_observations. evidence: ticker, accession, form, ts, url, period, holdings.
    """
    lanes = asked.select("ticker").distinct().join(identities, "ticker", "left")
    official = lanes.where("identity_status = 'official_series_class'").select("ticker", F.lpad("cik", 10, "0").alias("cik"), "series", "class")
    rows = filings.submissions(payloads.join(official.select("cik").distinct(), "cik", "left_semi")).join(payloads.select("cik", "payload_cik").distinct(), "cik")
    entries = filings.fund_filings(rows, cutoff, official.select(F.col("cik").alias("key"), "cik").distinct())
    entries = entries.join(official, "cik").withColumn("url", filings.archive_url(F.col("cik"), F.col("accession"), F.col("document")))
    good, _ = filings.fund_reports(landed.join(entries.select("url").distinct(), "url", "left_semi"), entries.select("url", "form", "cik", "series", "class"))
    judged = entries.join(good.select("url", "series", "class", "period", "holdings", F.lit(True).alias("_good")), ["url", "series", "class"], "left")
    evidence = judged.where("_good").select("ticker", "accession", "form", "ts", "url", "period", "holdings")
    failed = judged.where("_good is null")
    warnings = failed.select("ticker", F.col("ordinal").cast("int").alias("ordinal"), said("SEC fund filing ", F.col("accession"), " was unavailable, oversized, or invalid.").alias("warning"))
    reasons = failed.select("ticker", *_reason("source_unavailable", "candidate", F.col("accession"), "fund_document_unavailable_or_invalid"))
    typed = lanes.where("identity_status is not null and identity_status <> 'official_series_class'")
    unnamed = typed.select("ticker", F.lit(0).alias("ordinal"), said(F.col("ticker"), " fund identity is typed ", F.col("identity_status"), "; no series/class identity was inferred.").alias("warning"))
    unsupported = typed.select("ticker", *_reason("source_unsupported", "evaluation", F.col("ticker"), F.col("identity_status")))
    quiet = official.join(judged.select("ticker").distinct(), "ticker", "left_anti").select("ticker", F.lit(0).alias("ordinal"), said("No N-CEN or NPORT filings found for ", F.col("ticker"), " in the lookback window.").alias("warning"))
    counted = judged.groupBy("ticker").agg(F.count_if("_good").alias("items"), F.count("*").alias("entries"))
    status = (
        F.when(F.col("identity_status") != "official_series_class", UNSUPPORTED).when(F.col("items") > 0, FRESH).when(F.col("entries") > 0, UNAVAILABLE).otherwise(NONE)
    )
    results = lanes.join(counted, "ticker", "left").select("ticker", status.alias("status"), F.coalesce("items", F.lit(0)).alias("items"))
    return Collected(results, evidence, warnings.unionByName(unnamed).unionByName(quiet), reasons.unionByName(unsupported))
