"""Filing context, cached views, buckets and confirmations on small rows."""

from pyspark.sql import functions as F

from ferrule.operators import collectors


def test_filing_context(spark):
    rows = [
        (1, "8-K", ["9.01", "5.02"]), (2, "8-K/A", ["2.01", "3.01", "5.01"]), (3, "10-Q", []), (4, "SC 13D/A", None), (5, None, ["1.01"]), (6, "8-K", ["3.01", "1.03", None]),
        (7, "6-K", ["nonsense"]),
    ]
    found = spark.createDataFrame(rows, "id int, form string, codes array<string>").select("id", collectors.filing_context(F.col("form"), F.col("codes")).alias("c"))
    got = {r.id: r.c and (r.c.type, r.c.label, r.c.novelty) for r in found.collect()}
    assert got[1][0] == "leadership_change" and got[2] == ("acquisition_or_disposition", "Acquisition or disposition", "amendment")
    assert got[3][0] == "quarterly_report" and got[4] == ("sec_filing", "SEC SC 13D", "amendment") and got[5] is None
    assert got[6][0] == "bankruptcy" and got[7][0] == "foreign_issuer_report"


def test_states_of_failures(spark):
    rows = [(1, "status", 429), (2, "status", 403), (3, "status", 500), (4, "timeout", None), (5, None, None), (6, "status", None)]
    found = spark.createDataFrame(rows, "id int, kind string, code int").select(
        "id", collectors.failure_status(F.col("kind"), F.col("code")).alias("a"), collectors.failure_status(F.col("kind"), F.col("code"), True).alias("b"), collectors.known_status(F.col("kind")).alias("c")
    )
    assert {r.id: (r.a, r.b, r.c) for r in found.collect()} == {
        1: ("rate_limited", "rate_limited", "unavailable"), 2: ("permission_required", "permission_required", "unavailable"), 3: ("unavailable", "stale", "unavailable"),
        4: ("timeout", "timeout", "timeout"), 5: ("unavailable", "unavailable", "unavailable"), 6: ("unavailable", "stale", "unavailable"),
    }


def test_never_refreshed_and_failed_views(spark):
    rows = [("a", "never_refreshed", None, None, None), ("b", "failed", 7, "odd", None), ("c", "failed", None, None, "E"), ("d", "stale", 9, "fresh", None), ("e", "fresh", 1, "fresh", None)]
    states = spark.createDataFrame(rows, "issuer string, freshness string, last_success_age_seconds long, status string, error_class string")
    got = {r.issuer: (r.served_status, r.degraded, r.warning) for r in collectors.cached_view(states).collect()}
    assert got["a"][:2] == ("stale", True) and got["e"] == (None, False, None) and got["d"][0] == "stale"
    assert got["b"] == ("unavailable", True, "Background refresh failed with unknown error (unavailable); last success was 7 seconds ago.")
    assert got["c"] == ("stale", True, "Background refresh failed with E (stale); no successful refresh has completed.")


def test_replaced_days(spark):
    days = lambda rows: spark.createDataFrame(rows, "issuer string, source_id string, day string, posts long").withColumn("day", F.to_date("day"))
    old = days([("a", "s", "2024-01-01", 1), ("a", "s", "2024-01-02", 2), ("a", "s", "2024-01-15", 3), ("b", "s", "2023-01-01", 4)])
    got = collectors.replace_days(old, days([("a", "s", "2024-01-15", 0)])).collect()
    assert sorted((r.issuer, str(r.day), r.posts) for r in got) == [("a", "2024-01-02", 2), ("a", "2024-01-15", 0), ("b", "2023-01-01", 4)]


def test_own_rules_win_over_aliases(spark):
    rule = collectors.effective_rules(spark.createDataFrame([("7", ["Ä/B", "C"], "2026-01-01")], "issuer string, aliases array<string>, reviewed_on string"))
    assert [r["rule_id"] for r in rule.first()["rules"]] == ["legacy_alias_1", "legacy_alias_2"]
    again = collectors.effective_rules(rule.withColumn("aliases", F.array(F.lit("z"))))
    assert [r["alias"] for r in again.first()["rules"]] == ["Ä/B", "C"]
    version = lambda df: df.select(collectors.ruleset_version(F.col("rules")).alias("v")).first()["v"]
    assert version(rule) == version(again) and version(rule).startswith("entity-rules-v2:")


def test_links_of_confirmations(spark):
    pending = spark.createDataFrame(
        [("x", "v", 1, 1, None, None), ("x", "w", 2, 2, "bot", None), ("y", "v", 3, 3, None, None), ("z", "u", 1, 4, "qa", 1), ("q", "n", 9, 5, None, None)],
        "email string, visitor string, ts long, ordinal long, excluded_reason string, linked_at long",
    )
    confirmed = collectors.confirmations(pending)
    assert {r.email: (r.place, r.repeats) for r in confirmed.collect()} == {"x": ("unlinked", 1), "y": ("unlinked", 0), "z": ("excluded", 0), "q": ("unlinked", 0)}
    got = collectors.linked(confirmed, spark.createDataFrame([("v", 5), ("v", 6), ("u", 7), ("n", 2)], "visitor string, ts long"))
    assert {r.email: r.place for r in got.collect()} == {"x": "unlinked", "y": "linked", "z": "excluded", "q": "unlinked"}
