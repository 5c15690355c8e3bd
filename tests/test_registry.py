"""Registries: every failure at once, each at its path, and what a good one holds."""

import copy
import json

import pytest

from ferrule.operators import registry_rules as reg

FEED = {"feed_url": "https://Ir.acme.com/rss", "official_hosts": ["ir.acme.com"], "refresh_seconds": 300, "review_note": "checked"}
RULE = {
    "rule_id": "acme_name", "version": "1", "alias": "Acme", "alias_kind": "brand", "match_mode": "phrase", "required_context": ["orders"], "negative_context": ["anvil"], "valid_from": None, "valid_to": "2030-01-01",
    "canonical_cik": "CIK0000000001", "reviewed_on": "2026-01-01", "review_note": "n",
}
GOOD = {
    "version": 2,
    "issuers": [
        {"issuer_key": "CIK0000000001", "issuer_name": "Acme", "tickers": ["ACM", "ACM-B"], "reviewed_on": "2026-01-01", "discovery_rules": [RULE], "social_aliases": ["Acme Corp"], "issuer_feed": FEED},
        {"issuer_key": "CIK0000000002", "issuer_name": "Zed", "tickers": ["ZED"], "reviewed_on": "2026-01-01", "discovery_rules": [], "social_aliases": ["Zed Holdings"], "issuer_feed": None},
    ],
    "publisher_domains": [{"domain": "wire.example.com", "tier": "wire_service", "quality": 0.65, "reviewed_on": "2026-01-01", "review_note": "n"}],
    "funds": [{
        "fund_name": "Fund", "registrant_cik": "CIK0000000009", "series_id": "S000000001", "class_id": "C000000001", "identity_status": "official_series_class", "sponsor_source": {}, "reviewed_on": "2026-01-01", "review_note": "n",
        "ticker_versions": [{"ticker": "FND", "valid_from": None, "valid_to": "2020-01-01", "status": "inactive"}, {"ticker": "FND", "valid_from": "2020-01-02", "valid_to": None, "status": "active"}],
    }],
}


def changed(*changes):
    """GOOD with values put at paths like ("issuers", 0, "tickers"); DEL takes a key away."""
    found = copy.deepcopy(GOOD)
    for path, value in changes:
        at = found
        for p in path[:-1]:
            at = at[p]
        if value is DEL:
            del at[path[-1]]
        else:
            at[path[-1]] = copy.deepcopy(value)
    return found


DEL = object()
I0, R0, F0 = ("issuers", 0), ("issuers", 0, "discovery_rules", 0), ("funds", 0)
CASES = {
    "good": (GOOD, set()),
    "keys": (changed(((*I0, "x"), 1), ((*R0, "version"), DEL), (("y",), 2)), {("$.issuers[0].x", "unknown"), ("$.issuers[0].discovery_rules[0].version", "missing"), ("$.y", "unknown")}),
    "version": (changed((("version",), True)), {("$.version", "value"), }),
    "texts": (changed(((*I0, "issuer_name"), "a\tb"), (("issuers", 1, "issuer_name"), 'say "x"'), ((*R0, "review_note"), " "), ((*R0, "alias_kind"), "other")), {("$.issuers[0].issuer_name", "control_characters"), ("$.issuers[1].issuer_name", "quotes"), ("$.issuers[0].discovery_rules[0].review_note", "length"), ("$.issuers[0].discovery_rules[0].alias_kind", "form")}),
    "days": (changed(((*I0, "reviewed_on"), "2026-02-30"), ((*R0, "valid_from"), "2031-01-01")), {("$.issuers[0].reviewed_on", "form"), ("$.issuers[0].discovery_rules[0]", "reversed")}),
    "tickers": (changed(((*I0, "tickers"), ["ACM", "ACM", "a", 5]), (("issuers", 1, "tickers"), ["ACM"])), {("$.issuers[0].tickers[1]", "duplicate"), ("$.issuers[0].tickers[2]", "form"), ("$.issuers[0].tickers[3]", "not_text"), ("$.issuers[1].tickers[0]", "shared")}),
    "no tickers": (changed(((*I0, "tickers"), [])), {("$.issuers[0].tickers", "entries")}),
    "aliases": (changed((("issuers", 1, "social_aliases"), ["acme CORP", "Zed", "zed", "12", "12345"])), {("$.issuers[1].social_aliases[0]", "shared"), ("$.issuers[1].social_aliases[2]", "duplicate"), ("$.issuers[1].social_aliases[3]", "form"), ("$.issuers[1].social_aliases[4]", "form")}),
    "context": (changed(((*R0, "negative_context"), ["ORDERS", "x", "anvil"]), ((*R0, "canonical_cik"), "CIK0000000002"), ((*R0, "match_mode"), "ticker_token")), {("$.issuers[0].discovery_rules[0].negative_context", "form"), ("$.issuers[0].discovery_rules[0]", "overlap"), ("$.issuers[0].discovery_rules[0].canonical_cik", "owner"), ("$.issuers[0].discovery_rules[0].alias", "canonical")}),
    "rules": (changed(((*I0, "discovery_rules"), [RULE, RULE])), {("$.issuers[0].discovery_rules[1]", "duplicate")}),
    "keys of issuers": (changed((("issuers", 1, "issuer_key"), "CIK0000000001")), {("$.issuers[1].issuer_key", "duplicate")}),
    "idle": (changed((("issuers", 1, "social_aliases"), [])), {("$.issuers[1]", "no_collector")}),
    "feed": (changed(((*I0, "issuer_feed", "feed_url"), "https://u:p@ir.acme.com/rss"), ((*I0, "issuer_feed", "refresh_seconds"), 59)), {("$.issuers[0].issuer_feed.feed_url", "url"), ("$.issuers[0].issuer_feed.refresh_seconds", "value")}),
    "feed query": (changed(((*I0, "issuer_feed", "feed_url"), "https://ir.acme.com/rss?x=1")), {("$.issuers[0].issuer_feed.feed_url", "url")}),
    "feed host": (changed(((*I0, "issuer_feed", "feed_url"), "https://other.com/rss")), {("$.issuers[0].issuer_feed.feed_url", "host")}),
    "domains": (changed((("publisher_domains",), GOOD["publisher_domains"] * 2), (("publisher_domains", 0, "quality"), 0.9)), {("$.publisher_domains[0].quality", "value"), ("$.publisher_domains[1].quality", "value"), ("$.publisher_domains[1].domain", "duplicate")}),
    "funds": (changed(((*F0, "class_id"), None), ((*F0, "ticker_versions", 1, "valid_from"), "2019-01-01"), ((*F0, "ticker_versions", 0, "status"), "odd")), {("$.funds[0]", "identity_missing"), ("$.funds[0].ticker_versions[1]", "overlap"), ("$.funds[0].ticker_versions[0].status", "form")}),
    "fund tickers": (changed(((*F0, "ticker_versions", 0, "ticker"), "ZED"), ((*F0, "identity_status"), "unsupported_no_series_class")), {("$.funds[0].ticker_versions[0]", "issuer_ticker"), ("$.funds[0]", "identity_invented")}),
    "no list": (changed((("issuers",), {})), {("$.issuers", "not_list")}),
}
TEXTS = {"broken": ("{", {("$", "invalid_json")}), "null": (None, {("$", "invalid_json")}), "large": (json.dumps(GOOD) + " " * reg.MOST_BYTES, {("$", "too_large")}), "a list": ("[]", {("$", "not_object")})}


@pytest.fixture(scope="module")
def loaded(spark):
    rows = [(name, json.dumps(value)) for name, (value, _) in CASES.items()] + [(name, value) for name, (value, _) in TEXTS.items()]
    return reg.load_registry(spark.createDataFrame(rows, "registry_id string, payload string"))


def test_every_failure_at_its_path(loaded):
    found = {name: set() for name in (*CASES, *TEXTS)}
    for r in loaded.errors.collect():
        found[r.registry_id].add((r.path, r.rule))
    want = {name: errors for name, (_, errors) in (CASES | TEXTS).items()}
    want["version"] |= {("$.issuers[0].discovery_rules", "unknown")} & found["version"]  # no version says which rules an issuer has
    assert found == want


def test_what_a_good_registry_holds(loaded):
    assert {tuple(r) for r in loaded.issuers.collect()} == {("good", 0, "CIK0000000001", "Acme", "2026-01-01"), ("good", 1, "CIK0000000002", "Zed", "2026-01-01")}
    assert {r.ticker for r in loaded.tickers.collect()} == {"ACM", "ACM-B", "ZED"}
    assert {(r.kind, r.alias) for r in loaded.aliases.collect()} == {("discovery", "Acme"), ("social", "Acme Corp"), ("social", "Zed Holdings")}
    (rule,) = loaded.rules.collect()
    assert (rule.rule_id, rule.required, rule.negative, rule.valid_to) == ("acme_name", ["orders"], ["anvil"], "2030-01-01")
    assert [r.series_id for r in loaded.funds.collect()] == ["S000000001"]


def test_a_registry_may_have_its_own_bounds(spark):
    issuers = [{**GOOD["issuers"][1], "issuer_key": f"CIK{i:010}", "tickers": [f"Z{i}" if i < 239 else "zz"], "social_aliases": [f"Zed {i} Holdings"]} for i in range(240)]
    payload = spark.createDataFrame([("r", json.dumps({"version": 1, "issuers": [{**{k: v for k, v in i.items() if k != "discovery_rules"}, "discovery_aliases": []} for i in issuers]}))], "registry_id string, payload string")
    told = lambda *bounds: {(r.path, r.rule) for r in reg.load_registry(payload, *bounds).errors.collect()}
    assert told() == {("$.issuers", "entries")}
    assert told(2**31 - 1, 2**31 - 1) == {("$.issuers[239].tickers[0]", "form")}
