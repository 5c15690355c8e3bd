"""Typed reasons for what is missing, stale or failed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions.keys import hash_key, iso_utc
from ferrule.functions.numbers import seconds_between
from ferrule.functions.text import sanitize_warning
from ferrule.operators.score import EXPECTED

#: Precedence of source statuses and of reason codes, and statuses of families that need a licence.
STATUS_PRIORITY = {
    "permission_required": 9, "licensed_feed_required": 8, "rate_limited": 7, "timeout": 6, "schema_error": 5, "stale": 4,
    "no_observations": 3, "unsupported": 3, "unavailable": 2, "fresh": 1,
}
REASON_PRECEDENCE = {"source_unavailable": 10, "source_unsupported": 20, "entity_rejected": 30, "observed_none": 40, "discovery_only": 50, "evaluated_not_material": 60}
DEFAULT_MISSING = {"options_flow": "licensed_feed_required", "technical": "licensed_feed_required"}
#: Most reasons and warnings of a dossier.
MOST_REASONS, MOST_WARNINGS = 600, 18


def mapped(column: Column, table: dict, default=None) -> Column:
    found = F.lit(default)
    for key, value in table.items():
        found = F.when(column == key, F.lit(value)).otherwise(found)
    return found


def family_statuses(requests: DataFrame, evidence: DataFrame, statuses: DataFrame, expected: tuple[str, ...] = EXPECTED) -> DataFrame:
    """(request_id, family, available, status, reason, observed_at, coverage_ratio) of each expected family of each request.

    A family with evidence is fresh. Else the status with the highest priority of its collectors counts, the first by
    ordinal among equals; without any, the family's default.
    """
    wanted = requests.select("request_id", F.explode(F.array(*map(F.lit, expected))).alias("family"))
    seen = evidence.groupBy("request_id", "family").agg(F.max("ts").alias("observed_at"))
    worst = statuses.groupBy("request_id", "family").agg(
        F.max_by("status", F.struct(mapped(F.col("status"), STATUS_PRIORITY, 0), -F.col("ordinal"))).alias("worst")
    )
    found = wanted.join(seen, ["request_id", "family"], "left").join(worst, ["request_id", "family"], "left")
    fresh = F.col("observed_at").isNotNull()
    missing = F.coalesce("worst", mapped(F.col("family"), DEFAULT_MISSING, "no_observations"))
    status = F.when(fresh, "fresh").otherwise(missing)
    reason = (
        F.when(fresh, "fresh_evidence")
        .when((F.col("family") == "options_flow") & (missing == "licensed_feed_required"), "licensed_transaction_feed_required")
        .when((F.col("family") == "technical") & (missing == "licensed_feed_required"), "licensed_ohlc_feed_required")
        .otherwise(missing)
    )
    return found.select("request_id", "family", fresh.alias("available"), status.alias("status"), reason.alias("reason"), "observed_at", fresh.cast("double").alias("coverage_ratio"))


def dossier_coverage(family_status: DataFrame) -> DataFrame:
    """(request_id, coverage, missing_families): none, partial or complete, and what is missing, sorted."""
    found = family_status.groupBy("request_id").agg(
        F.count_if("available").alias("n"), F.count("*").alias("of"), F.array_sort(F.collect_list(F.when(~F.col("available"), F.col("family")))).alias("missing_families")
    )
    coverage = F.when(F.col("n") == 0, "none").when(F.col("n") == F.col("of"), "complete").otherwise("partial")
    return found.select("request_id", coverage.alias("coverage"), "missing_families")


def freshness(states: DataFrame, now: Column, max_age_seconds: int) -> DataFrame:
    """states with freshness and last_success_age_seconds.

    states: last_checked_at, last_success_at, status. A check after the last success that was neither fresh nor empty is a failure;
    without a success there never was a refresh; a success older than allowed is stale.
    """
    age = F.greatest(F.lit(0), F.floor(seconds_between(now, F.col("last_success_at")))).cast("long")
    failed = (
        F.col("last_checked_at").isNotNull()
        & (F.col("last_success_at").isNull() | (F.col("last_checked_at") > F.col("last_success_at")))
        & ~F.coalesce(F.col("status"), F.lit("")).isin("fresh", "no_observations")
    )
    state = F.when(failed, "failed").when(F.col("last_success_at").isNull(), "never_refreshed").when(age > max_age_seconds, "stale").otherwise("fresh")
    return states.withColumn("last_success_age_seconds", F.when(F.col("last_success_at").isNotNull(), age)).withColumn("freshness", state)


def merge_state(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Collector states after an update: what is null in the new row keeps its old value, and a failed check keeps the last success."""
    names = [c for c in new.columns if c not in keys]
    both = old.select(*keys, *(F.col(c).alias(f"_old_{c}") for c in names), F.lit(True).alias("_old")).join(new.withColumn("_new", F.lit(True)), keys, "full")
    return both.select(*keys, *(F.coalesce(F.col(c), F.col(f"_old_{c}")).alias(c) for c in names))


def reasons(rows: DataFrame) -> DataFrame:
    """rows of (request_id, code, scope, scope_id, source_id, family, observed_at, detail) with reason_id and precedence, each id once for a request."""
    observed = F.when(F.col("observed_at").isNotNull(), iso_utc(F.col("observed_at"))).otherwise("")
    ident = F.concat(F.lit("rsn_"), hash_key("code", "scope", "scope_id", "source_id", "family", observed, "detail"))
    found = rows.withColumn("reason_id", ident).withColumn("precedence", mapped(F.col("code"), REASON_PRECEDENCE))
    return found.dropDuplicates(["request_id", "reason_id"])


def ordered_reasons(rows: DataFrame, most: int = MOST_REASONS) -> DataFrame:
    """The first reasons of each request by precedence, code, scope and ids, with place, total and whether there are more."""
    order = Window.partitionBy("request_id").orderBy("precedence", "code", "scope", "scope_id", "reason_id")
    whole = Window.partitionBy("request_id")
    placed = rows.withColumn("place", F.row_number().over(order)).withColumn("total", F.count("*").over(whole))
    return placed.where(F.col("place") <= most).withColumn("truncated", F.col("total") > most)


def warnings(texts: Column, caveats: tuple[str, ...], most: int = MOST_WARNINGS) -> Column:
    """The array of warnings, sanitised, each once in order, cut so that the caveats still fit."""
    kept = F.slice(F.array_distinct(F.transform(texts, sanitize_warning)), 1, most - len(caveats))
    return F.concat(kept, F.array(*map(F.lit, caveats)))
