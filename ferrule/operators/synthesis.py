"""Synthesis of a dossier: headline, what changed, why it matters, what would invalidate it, and what to check next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.functions.keys import iso_utc
from ferrule.functions.text import safe_text
from ferrule.operators.quality import mapped

#: Labels of families and signals, and the sentences of a synthesis.
FAMILY_LABELS = {
    "filings_news": "Filings and news", "insider_trading": "Insider activity", "options_flow": "Options activity",
    "technical": "Technical transitions", "social": "Social attention", "alternative": "Alternative evidence",
}
SIGNAL_LABELS = {
    "sec_form_8_k": "A new SEC Form 8-K was observed.",
    "sec_form_8_k_a": "An amended SEC Form 8-K was observed.",
    "insider_purchase_cluster": "Multiple insiders reported open-market acquisitions.",
    "insider_purchase_strong_cluster": "Three or more insiders reported open-market acquisitions.",
    "insider_sale_cluster": "Multiple insiders reported open-market dispositions.",
    "insider_sale_strong_cluster": "Three or more insiders reported open-market dispositions.",
    "insider_proposed_sale_intent": "A Form 144 reported proposed sale intent, not execution.",
    "social_sentiment_increase": "Sentiment strengthened while attention held or increased.",
    "social_sentiment_decrease": "Sentiment weakened while attention held or increased.",
    "call_activity_increase": "Call-side options activity increased versus its baseline.",
    "put_activity_increase": "Put-side options activity increased versus its baseline.",
}
LEADING_WHY = "The leading observation is the strongest normalized change in the current window."
INVALID_CORRECTION = "A later canonical version supersedes or reverses the reported correction."
INVALID_TRADE = "A later Form 4 amendment changes the transaction code, shares, price, ownership form, or 10b5-1 context."
INVALID_PROPOSED = "A later filing changes the proposed terms, or no completed disposition is subsequently reported."
INVALID_FILING = "A later SEC amendment or issuer-primary disclosure changes the filed facts."
INVALID_FAMILY = {
    "options_flow": "Options activity normalizes during the requested horizon.",
    "technical": "The observed technical transition reverses on daily data.",
    "social": "Attention or sentiment normalizes during the next comparison window.",
}
INVALID_OTHER = "A later primary-source record changes the normalized facts."
INVALID_SECTOR = "A sector-wide event fully explains the ticker-specific observations."
CHECK_TRADE = "Verify each Form 4 transaction code, shares, price, ownership form, and 10b5-1 footnotes."
CHECK_PROPOSED = "Track later Form 4 filings; the Form 144 records proposed intent, not execution."
CHECK_CORRECTION = "Compare the correction with the prior canonical event version."
CHECK_CONFLICT = "Resolve conflicting evidence against the highest-tier primary source."
CHECK_SECTOR = "Check whether a sector-wide event explains the observation."
CHECK_MODE = {
    "thesis_review": "Compare the evidence with the prior thesis invalidation criteria.",
    "alert_triage": "Confirm the newest event timestamp before escalating the alert.",
}
EMPTY_HEADLINE = "No recent catalyst evidence was available from configured sources."
EMPTY_CHANGED = "No fresh normalized evidence was collected."
EMPTY_WHY = "Missing observations prevent a directional assessment."
EMPTY_INVALID = "Fresh primary-source evidence becomes available."
CHECK_WIDER = "Retry with lookback_days=30 to check a wider filing window."
CHECK_OPEN = "Open the issuer's recent SEC filings and verify whether qualifying evidence exists."
CHECK_IDENTITY = "Confirm the monitored SEC identity and configured-source statuses."
#: Changes from which no further item is told, sentences of a list, and checks of single items.
ENOUGH_CHANGES, MOST_SENTENCES, ITEM_CHECKS = 4, 5, 3

#: Columns of an item's context, null where it has none.
CONTEXT = {
    "change": "string", "record_id": "string", "has_sources": "boolean", "event_label": "string", "event_type": "string", "why": "string", "novelty": "string",
    "source_records": "int", "corroborating": "int",
}


def _told(items: DataFrame) -> DataFrame:
    """items with what each says by itself: label, text, support, invalid, check."""
    c = F.col
    for name, kind in CONTEXT.items():
        if name not in items.columns:
            items = items.withColumn(name, F.lit(None).cast(kind))
    family = mapped(c("family"), FAMILY_LABELS)
    changed = F.concat(F.coalesce(family, F.lit("Evidence")), F.lit(" changed during the requested window."))
    more = F.concat(F.lit("The canonical event has "), c("corroborating").cast("string"), F.lit(" additional source record"), F.when(c("corroborating") == 1, ".").otherwise("s."))
    records = F.concat(F.lit("The observation is supported by "), c("source_records").cast("string"), F.lit(" source records."))
    trade, proposed = F.startswith(c("event_type"), F.lit("open_market_")), c("event_type") == "proposed_insider_sale"
    filed = c("family") == "filings_news"
    accession = F.concat(F.lit("Open SEC accession "), c("record_id"), F.lit(" and review the filed item text and exhibits."))
    return items.withColumns({
        "label": F.coalesce("event_label", family, F.lit("Catalyst evidence")),
        "text": F.coalesce(safe_text(c("change")), mapped(c("signal"), SIGNAL_LABELS), changed),
        "support": F.when(c("corroborating") > 0, more).when(c("source_records") > 1, records),
        "why": F.coalesce("why", F.lit(LEADING_WHY)),
        "invalid": F.when(c("novelty") == "correction", INVALID_CORRECTION).when(trade, INVALID_TRADE).when(proposed, INVALID_PROPOSED)
        .when(filed & c("has_sources"), INVALID_FILING).otherwise(F.coalesce(mapped(c("family"), INVALID_FAMILY), F.lit(INVALID_OTHER))),
        "check": F.when(filed & (c("record_id") != ""), accession).when(trade, CHECK_TRADE).when(proposed, CHECK_PROPOSED).when(c("novelty") == "correction", CHECK_CORRECTION),
    })


def _list(*entries: tuple[Column, Column | str]) -> Column:
    """The texts whose condition holds, in order."""
    return F.array_compact(F.array(*(F.when(when, F.lit(text) if isinstance(text, str) else text) for when, text in entries)))


def summaries(items: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, headline, what_changed, why_it_matters, what_would_invalidate, next_checks) of each request.

    items: the few selected of each request, with request_id, ordinal, family, signal, direction, contribution, ts and any columns
    of CONTEXT. requests: request_id, risk_mode, lookback_days, missing (families without evidence). Sentences are made
    row by row; then a request's items, bounded by the selection, meet in one array. A request without items gets the sentences for that.
    """
    micros = F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), F.col("ts"))
    item = F.struct(
        (-F.abs("contribution")).alias("weight"), (-micros).alias("age"), "ordinal", "direction", "family", "label", "text", "support", "why", "invalid", "check",
        iso_utc(F.col("ts")).alias("time"),
    )
    grouped = _told(items).groupBy("request_id").agg(F.array_sort(F.collect_list(item)).alias("ranked"))
    by_time = F.array_sort(F.transform("ranked", lambda x: F.struct(x["age"].alias("age"), x["ordinal"].alias("ordinal"), x["label"].alias("label"), x["text"].alias("text"), x["time"].alias("time"), x["check"].alias("check"))))
    found = requests.select("request_id", "risk_mode", "lookback_days", F.array_sort("missing").alias("missing")).join(grouped, "request_id", "left")
    directed = F.filter("ranked", lambda x: x["direction"] != "neutral")
    found = found.withColumns({"by_time": by_time, "leading": F.get("ranked", F.lit(0)), "leader": F.get(directed, F.lit(0))["direction"]})
    found = found.withColumns({"newest": F.get("by_time", F.lit(0)), "against": F.get(F.filter("ranked", lambda x: (x["direction"] != "neutral") & (x["direction"] != F.col("leader"))), F.lit(0))})
    c = F.col
    opposed, lacking = c("against").isNotNull(), F.size("missing") > 0
    missing = F.array_join("missing", ", ")
    said = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    headline = (
        F.when(c("risk_mode") == "alert_triage", said(c("newest.label"), ": ", c("newest.text"), " Observed ", c("newest.time"), "."))
        .when(c("risk_mode") == "thesis_review", said("Thesis-review evidence — ", c("leading.label"), ": ", c("leading.text")))
        .otherwise(said(c("leading.label"), ": ", c("leading.text")))
    )
    told = lambda acc, x: F.when(F.size(acc) >= ENOUGH_CHANGES, acc).otherwise(F.array_distinct(F.concat(acc, F.array_compact(F.array(x["text"], x["support"])))))
    changes = F.concat(
        F.aggregate("ranked", F.array().cast("array<string>"), told),
        _list((opposed, said("Conflicting evidence: ", c("against.text"))), (~opposed & lacking, said("Missing confirmation: ", missing, "."))),
    )
    why = F.concat_ws(
        " ", c("leading.why"), c("leading.support"),
        F.when(opposed, said("Conflicting ", c("against.direction"), " evidence is also present: ", c("against.text"))),
        F.when(lacking, said("Confidence remains constrained by missing ", missing, ".")),
    )
    invalid = _list(
        (F.lit(True), c("leading.invalid")),
        (opposed, said("The conflicting ", c("against.direction"), " observation becomes the better-supported primary-source account.")),
        (lacking, said("Obtain missing confirmation from ", missing, ".")),
        (F.exists("ranked", lambda x: x["family"] != "filings_news"), INVALID_SECTOR),
    )
    single = F.slice(F.filter(F.transform("by_time", lambda x: x["check"]), lambda x: x.isNotNull()), 1, ITEM_CHECKS)
    checks = F.concat(single, _list((opposed, CHECK_CONFLICT), (F.lit(True), CHECK_SECTOR), *((c("risk_mode") == mode, text) for mode, text in CHECK_MODE.items())))
    empty = c("ranked").isNull()
    few = lambda texts: F.transform(F.slice(texts, 1, MOST_SENTENCES), safe_text)
    return found.select(
        "request_id",
        F.when(empty, EMPTY_HEADLINE).otherwise(safe_text(headline)).alias("headline"),
        F.when(empty, F.array(F.lit(EMPTY_CHANGED))).otherwise(few(changes)).alias("what_changed"),
        F.when(empty, EMPTY_WHY).otherwise(safe_text(why)).alias("why_it_matters"),
        F.when(empty, F.array(F.lit(EMPTY_INVALID))).otherwise(few(invalid)).alias("what_would_invalidate"),
        F.when(empty, _list((c("lookback_days") < 30, CHECK_WIDER), (F.lit(True), CHECK_OPEN), (F.lit(True), CHECK_IDENTITY)))
        .otherwise(F.slice(F.array_distinct(F.transform(checks, safe_text)), 1, MOST_SENTENCES)).alias("next_checks"),
    )
