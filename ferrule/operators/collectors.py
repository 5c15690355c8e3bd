"""What collectors add to landed rows: context of filings, states of failures, cached views, registries and confirmations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.operators.quality import STATUS_PRIORITY

# Type, label, reason and weight of an item code of current reports, of a form without one, and of any other form; codes by priority.
ITEM_CONTEXT = {
    "1.01": ("material_agreement", "Material definitive agreement", "A new or amended material contract can change committed economics, obligations, or strategic scope.", "material"),
    "1.02": ("material_agreement_termination", "Termination of a material agreement", "Ending a material contract can change expected economics, counterparties, or operating plans.", "material"),
    "1.03": ("bankruptcy", "Bankruptcy or receivership", "Bankruptcy or receivership directly changes solvency, control, and claim priority.", "critical"),
    "2.01": ("acquisition_or_disposition", "Acquisition or disposition", "A completed acquisition or disposition can materially change assets, liabilities, and operating scope.", "material"),
    "2.02": ("financial_results", "Results of operations and financial condition", "Reported operating or financial results update the primary evidence for recent company performance.", "material"),
    "2.03": ("financial_obligation", "Creation of a financial obligation", "A material financial obligation can change leverage, liquidity, and future cash commitments.", "material"),
    "2.04": ("obligation_trigger", "Triggering events for financial obligations", "An acceleration or similar trigger can change near-term liquidity and repayment risk.", "critical"),
    "2.05": ("restructuring", "Exit or disposal activities", "A restructuring or disposal plan can change costs, staffing, and operating capacity.", "material"),
    "2.06": ("impairment", "Material impairment", "A material impairment changes the carrying value of assets and may signal weaker expected economics.", "material"),
    "3.01": ("delisting", "Delisting or listing-rule notice", "A listing notice can affect market access and may require remediation within a stated period.", "critical"),
    "3.02": ("unregistered_security_sale", "Unregistered sale of equity securities", "A securities issuance can change capitalization and potential dilution.", "material"),
    "3.03": ("security_holder_rights", "Material modification of security-holder rights", "A rights modification can change the economics or control attached to outstanding securities.", "material"),
    "4.01": ("auditor_change", "Change in certifying accountant", "An auditor change warrants review of the stated reason, disagreements, and transition disclosures.", "material"),
    "4.02": ("restatement", "Non-reliance on prior financial statements", "A non-reliance determination can invalidate prior financial information and require corrected reporting.", "critical"),
    "5.02": ("leadership_change", "Director or executive change", "A board or executive transition can change governance, operating responsibility, or succession risk.", "material"),
    "5.03": ("governance_change", "Charter or bylaw amendment", "A governing-document change can alter shareholder rights or corporate decision rules.", "contextual"),
    "5.07": ("shareholder_vote", "Shareholder vote results", "Voting results establish which proposals and governance actions received shareholder approval.", "contextual"),
    "7.01": ("regulation_fd", "Regulation FD disclosure", "A Regulation FD disclosure points to information the issuer considered appropriate for broad public dissemination.", "contextual"),
    "8.01": ("other_material_event", "Other material event", "The issuer elected to report an event it considered material or useful to investors.", "material"),
    "9.01": ("exhibits", "Financial statements and exhibits", "Filed exhibits may contain the detailed primary facts supporting the current report.", "supporting"),
}
FORM_CONTEXT = {
    "6-K": ("foreign_issuer_report", "Foreign issuer current report", "A Form 6-K supplies current information disclosed by a foreign private issuer.", "material"),
    "10-Q": ("quarterly_report", "Quarterly report", "A Form 10-Q updates financial statements, risks, and management discussion for the latest quarter.", "material"),
    "10-K": ("annual_report", "Annual report", "A Form 10-K updates audited financials, risks, controls, and the issuer's annual operating record.", "material"),
    "20-F": ("foreign_annual_report", "Foreign issuer annual report", "A Form 20-F updates the foreign issuer's annual financial and operating record.", "material"),
    "40-F": ("canadian_annual_report", "Canadian issuer annual report", "A Form 40-F updates the Canadian issuer's annual financial and operating record.", "material"),
}
OTHER_CONTEXT = ("sec_filing", "The filing updates the issuer's primary regulatory record.", "contextual")
ITEM_PRIORITY = ("1.03", "2.04", "4.02", "3.01", "2.01", "2.02", "2.03", "2.05", "2.06", "1.01", "1.02", "3.02", "3.03", "4.01", "5.02", "5.03", "5.07", "7.01", "8.01", "9.01")
CONTROL_CHANGE = ("2.01", "3.01", "5.01")
RULESET_PREFIX, DECISION_VERSION = "entity-rules-v2", "title-alignment-v1"
#: Days of attention kept beside a failed one.
KEPT_DAYS = 13


def filing_context(form: Column, codes: Column) -> Column:
    """Struct (type, label, why, materiality, novelty) of a filing by its first item code in order of priority, else by its form.

    codes: array of item codes; null counts as empty. A listing notice beside a completed change of control is no sign of trouble. Null forms
    have a null context.
    """
    base, codes = F.regexp_replace(form, "/A$", ""), F.coalesce(codes, F.array().cast("array<string>"))
    gone = F.size(F.array_intersect(codes, F.array(*map(F.lit, CONTROL_CHANGE)))) == len(CONTROL_CHANGE)
    eligible = F.when(gone, F.array_remove(codes, "3.01")).otherwise(codes)
    first = F.get(F.array_intersect(F.array(*map(F.lit, ITEM_PRIORITY)), eligible), F.lit(0))
    kind = lambda values: F.struct(*(F.lit(v).alias(n) for n, v in zip(("type", "label", "why", "materiality"), values)))
    known = F.create_map(*(x for key, values in (ITEM_CONTEXT | FORM_CONTEXT).items() for x in (F.lit(key), kind(values))))
    name, why, weight = OTHER_CONTEXT
    other = F.struct(F.lit(name).alias("type"), F.concat(F.lit("SEC "), base).alias("label"), F.lit(why).alias("why"), F.lit(weight).alias("materiality"))
    found = F.coalesce(F.try_element_at(known, F.coalesce(first, base)), other)
    return F.when(form.isNotNull(), found.withField("novelty", F.when(form.endswith("/A"), "amendment").otherwise("new_event")))


def failure_status(kind: Column, code: Column, refresh: bool = False) -> Column:
    """Status of a failed call: kind is status (with an HTTP code), timeout, schema, no_file, transport or another.

    A failed background refresh leaves an older cache, so there other codes, missing files and broken transports count as stale.
    """
    lost = F.lit("stale" if refresh else "unavailable")
    by_code = F.when(code == 429, "rate_limited").when(code.isin(401, 403), "permission_required").otherwise(lost)
    return F.when(kind == "status", by_code).when(kind == "timeout", "timeout").when(kind == "schema", "schema_error").when(kind.isin("no_file", "transport"), lost).otherwise("unavailable")


def known_status(text: Column) -> Column:
    """text where it names a status; anything else, null too, is unavailable."""
    return F.when(text.isin(*STATUS_PRIORITY), text).otherwise("unavailable")


def cached_view(states: DataFrame) -> DataFrame:
    """states, which went through quality.freshness and have status and error_class, with served_status, degraded and warning.

    Cached rows are served whatever the state. Fresh ones go without a warning and keep a null served_status, as then their rows
    decide; after a failure the failed check's status is served.
    """
    age, state = F.col("last_success_age_seconds").cast("string"), F.col("freshness")
    failed = F.when(F.col("status").isNull(), "stale").otherwise(known_status(F.col("status")))
    since = F.when(age.isNull(), "; no successful refresh has completed").otherwise(F.concat(F.lit("; last success was "), age, F.lit(" seconds ago")))
    warning = (
        F.when(state == "failed", F.concat(F.lit("Background refresh failed with "), F.coalesce("error_class", F.lit("unknown error")), F.lit(" ("), failed, F.lit(")"), since, F.lit(".")))
        .when(state == "stale", F.concat(F.lit("Background cache is stale; last successful refresh was "), age, F.lit(" seconds ago.")))
        .when(state == "never_refreshed", "Background refresh has not completed a successful refresh.")
    )
    served = F.when(state == "failed", failed).when(state != "fresh", "stale")
    return states.select("*", served.alias("served_status"), (state != "fresh").alias("degraded"), warning.alias("warning"))


def replace_days(buckets: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("issuer", "source_id"), day: str = "day", kept_days: int = KEPT_DAYS) -> DataFrame:
    """Daily buckets after new ones took the place of those of the same keys and day; keys with a new day keep only kept_days before their newest new one."""
    newest = new.groupBy(*keys).agg(F.max(day).alias("_newest"))
    whole = buckets.join(new.select(*keys, day), [*keys, day], "left_anti").unionByName(new)
    old = F.col("_newest").isNotNull() & (F.col(day) < F.date_sub("_newest", kept_days))
    return whole.join(newest, list(keys), "left").where(~old).drop("_newest")


def failed_day(keys: DataFrame, status: Column, day: str = "day") -> DataFrame:
    """A bucket without posts for each row of keys, whose coverage state is the status of the failure."""
    return keys.select("*", F.lit(0).cast("long").alias("posts"), F.lit(0).cast("long").alias("authors"), F.lit(0.0).alias("coverage"), known_status(status).alias("coverage_state"))


def effective_rules(issuers: DataFrame) -> DataFrame:
    """issuers (issuer, aliases, reviewed_on, rules) with their rules, or, where there are none, a phrase rule for each alias without conditions."""
    none = F.array().cast("array<string>")
    legacy = F.transform(
        "aliases",
        lambda alias, i: F.struct(
            alias.alias("alias"), F.lit("legal_name").alias("alias_kind"), F.col("issuer").alias("canonical_cik"), F.lit("phrase").alias("match_mode"), none.alias("negative_context"),
            none.alias("required_context"), F.lit("Registry v1 compatibility rule.").alias("review_note"), F.col("reviewed_on").alias("reviewed_on"),
            F.concat(F.lit("legacy_alias_"), i + 1).alias("rule_id"), F.lit(None).cast("string").alias("valid_from"), F.lit(None).cast("string").alias("valid_to"), F.lit("1").alias("version"),
        ),
    )
    rules = F.when(F.size(F.coalesce("rules", F.expr("array()"))) > 0, F.col("rules")).otherwise(legacy) if "rules" in issuers.columns else legacy
    return issuers.withColumn("rules", rules)


def ruleset_version(rules: Column) -> Column:
    """Hash of the rules as JSON with sorted names; rules: array of structs whose fields are in order of their names."""
    whole = F.to_json(F.struct(F.lit(DECISION_VERSION).alias("decision_version"), rules.alias("rules")), {"ignoreNullFields": "false"})
    return F.concat(F.lit(RULESET_PREFIX + ":"), F.sha2(whole, 256))


def news_query(aliases: Column) -> Column:
    """Aliases in quotes, joined by OR in brackets if there are several."""
    joined = F.array_join(F.transform(aliases, lambda a: F.concat(F.lit('"'), a, F.lit('"'))), " OR ")
    return F.when(F.size(aliases) == 1, joined).otherwise(F.concat(F.lit("("), joined, F.lit(")")))


def social_query(tickers: Column, aliases: Column) -> Column:
    """Tickers behind a dollar sign, then aliases in quotes, joined by bars."""
    return F.array_join(F.concat(F.transform(tickers, lambda t: F.concat(F.lit("$"), t)), F.transform(aliases, lambda a: F.concat(F.lit('"'), a, F.lit('"')))), " | ")


def last_by(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each value of keys: sources of one URL count once, as the last names them."""
    names = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*names), order).alias("_last")).select(*keys, *(F.col("_last")[c].alias(c) for c in names))


def confirmations(pending: DataFrame) -> DataFrame:
    """(email, place, visitor, ts, repeats): an address counts with its first confirmation, which is excluded, linked or unlinked.

    pending: email, visitor, ts, ordinal, excluded_reason, linked_at.
    """
    place = F.when(F.col("excluded_reason").isNotNull(), "excluded").when(F.col("linked_at").isNotNull(), "linked").otherwise("unlinked")
    first = F.min_by(F.struct(place.alias("place"), "visitor", "ts"), F.struct("ts", "ordinal"))
    return pending.groupBy("email").agg(first.alias("_first"), (F.count("*") - 1).alias("repeats")).select("email", "_first.*", "repeats")


def linked(confirmed: DataFrame, activations: DataFrame) -> DataFrame:
    """confirmed after activation reports: an unlinked address is linked by its visitor's first report if that comes after its confirmation.

    A visitor's later reports are repeats and do nothing. A visitor who confirmed several addresses stands for the latest one at the report.
    """
    first = activations.groupBy("visitor").agg(F.min("ts").alias("_at"))
    met = confirmed.join(first, "visitor", "left").withColumn("_before", F.coalesce(F.col("ts") <= F.col("_at"), F.lit(False)))
    latest = F.row_number().over(Window.partitionBy("visitor", "_before").orderBy(F.desc("ts"), F.desc("email"))) == 1
    moved = F.col("_before") & latest & (F.col("place") == "unlinked")
    return met.select(*(F.when(moved, "linked").otherwise(F.col("place")).alias("place") if c == "place" else F.col(c) for c in confirmed.columns))


def refresh_due(issuers: DataFrame, states: DataFrame, interval_seconds: int, now: Column) -> DataFrame:
    """(collector, seconds) until the first issuer of each collector is due: issuers (collector, issuer), states (collector, issuer, last_checked_at).

    An issuer that was never checked is due now, another interval_seconds after its last check. Issuers that repeat count once.
    """
    met = issuers.select("collector", "issuer").distinct().join(states.groupBy("collector", "issuer").agg(F.max("last_checked_at").alias("last")), ["collector", "issuer"], "left")
    left = F.lit(interval_seconds * 1_000_000) - F.timestamp_diff("MICROSECOND", F.col("last"), now)
    return met.groupBy("collector").agg(F.min(F.when(F.col("last").isNull(), F.lit(0.0)).otherwise(F.greatest(left / 1e6, F.lit(0.0)))).alias("seconds"))
