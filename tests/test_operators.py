"""Operators on small frames, by hand and by plain Python."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ferrule.operators import assembly, documents, evidence, graph, operations, quality, redact, resolve, score, signals

NOW = datetime(2026, 7, 12, 16)
EVIDENCE = "request_id long, ordinal long, family string, signal string, direction string, strength double, confidence double, quality double, ts timestamp_ntz, source_url string"


def item(ordinal=0, family="options_flow", direction="bullish", strength=0.8, confidence=0.75, quality=0.9, age=0.0, request=1):
    return (request, ordinal, family, f"s{ordinal}", direction, strength, confidence, quality, NOW - timedelta(days=age), None)


def as_of():
    return F.lit(NOW).cast("timestamp_ntz")


def scored(spark, *items, expected=score.EXPECTED):
    return score.scores(spark.createDataFrame(items, EVIDENCE), as_of(), 14, expected).first()


def test_scores_by_hand(spark):
    assert scored(spark, item(strength=0.8, confidence=0.5, quality=0.5), expected=("options_flow",)).score == 52
    assert scored(spark, item(direction="bearish", strength=1.0, confidence=1.0, quality=1.0), expected=("options_flow", "filings_news")).score == 42
    assert scored(spark, item(family="filings_news", strength=1.0, confidence=1.0, quality=1.0, age=7), expected=("filings_news",)).score == 58
    assert scored(spark, item(direction="neutral")).direction == "neutral"
    quiet = score.with_quiet_requests(spark.createDataFrame([(9,)], "request_id long"), score.scores(spark.createDataFrame([], EVIDENCE), as_of(), 14))
    assert quiet.first()[1:4] == (50, "neutral", 0.0)


def test_items_sum_to_their_family(spark):
    items = [item(i, "social", strength=1.0, confidence=1.0, quality=1.0) for i in range(3)] + [item(9, "technical"), item(10, "technical", "bearish")]
    rows = score.contributions(spark.createDataFrame(items, EVIDENCE), as_of(), 14).collect()
    social = [r for r in rows if r.family == "social"]
    assert abs(sum(r.contribution for r in social) - 4) < 1e-9 and social[0].family_points == 4
    technical = [r.contribution for r in rows if r.family == "technical"]
    assert technical[0] == -technical[1] != 0


def plain_selection(items, most):
    ranked = sorted(items, key=lambda i: (-abs(i[1]), -i[2], i[0]))
    top = ranked[:most]
    both, shown = {i[3] for i in ranked} - {"neutral"}, {i[3] for i in top} - {"neutral"}
    if len(both) > 1 and len(shown) == 1:
        top[-1] = next(i for i in ranked if i[3] not in shown and i[3] != "neutral")
    return {i[0] for i in top}


def test_selection_keeps_a_contradiction(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for g in range(200):
        items = [(n, rng.choice((0.0, 1.0, 2.0, 3.5)), rng.randrange(3), rng.choice(("bullish", "bullish", "bearish", "neutral"))) for n in range(rng.randrange(1, 9))]
        want[g] = plain_selection(items, 3)
        rows += [(g, n, "f", d, c, NOW + timedelta(hours=t)) for n, c, t, d in items]
    frame = spark.createDataFrame(rows, "request_id long, ordinal long, family string, direction string, contribution double, ts timestamp_ntz")
    got = {}
    for r in evidence.compact_families(frame).collect():
        got.setdefault(r.request_id, set()).add(r.ordinal)
    assert got == want


def test_shown(spark):
    frame = spark.createDataFrame([(["a", "b", "c", "d"], "raw")], "sources array<string>, raw_signal string")
    row = evidence.shown(frame, F.lit(True), F.lit(False)).first()
    assert row.sources == ["a", "b", "c"] and row.raw_signal is None


def test_insiders(spark):
    trade = lambda owner, code, age, planned=False, shares=10.0: ("X", owner, code, "A" if code == "P" else "D", False, planned, shares, 2.0, NOW - timedelta(days=age), f"u{owner}")
    schema = "issuer string, owner string, code string, acquired_disposed string, derivative boolean, planned boolean, shares double, price double, ts timestamp_ntz, url string"
    found = lambda *rows: signals.insider_clusters(spark.createDataFrame(rows, schema), as_of(), 14).first()
    r = found(trade("a", "P", 1), trade("b", "P", 2), trade("c", "S", 10))
    assert (r.signal, r.direction, r.confidence, r.novelty, r.net, r.prior_net) == ("insider_purchase_cluster", "bullish", 0.82, "direction_reversal", 40, -20)
    assert found(trade("a", "S", 1, True), trade("b", "S", 1), trade("c", "S", 1)).confidence == 0.5
    assert found(trade("a", "P", 1), trade("b", "S", 1)).signal == "insider_mixed_activity"
    assert found(trade("a", "P", 9)) is None and found(trade("a", "P", 1, shares=-1.0)) is None


def test_reasons_and_warnings(spark):
    row = (1, "observed_none", "family", "x", None, None, None, None)
    frame = spark.createDataFrame([row, row, (1, "source_unavailable", "source", "y", None, None, None, None)], "request_id long, code string, scope string, scope_id string, source_id string, family string, observed_at timestamp_ntz, detail string")
    rows = quality.ordered_reasons(quality.reasons(frame)).orderBy("place").collect()
    assert [r.code for r in rows] == ["source_unavailable", "observed_none"] and rows[0].total == 2 and not rows[0].truncated
    texts = F.array(*(F.lit(f"w{i % 30}") for i in range(60)))
    got = spark.range(1).select(quality.warnings(texts, ("c1", "c2")).alias("w")).first().w
    assert got == [f"w{i}" for i in range(16)] + ["c1", "c2"]


RULES = [("acme", "r1", "Acme", ["chips"], ["anvil"], None, None), ("acme", "r2", "Acme Old", [], [], None, "2018-01-01"), ("zed", "z1", "Zed", [], [], None, None)]


def test_entities(spark):
    rules = spark.createDataFrame(RULES, "issuer string, rule_id string, alias string, required array<string>, negative array<string>, valid_from string, valid_to string")
    texts = [(0, "Acme makes chips", "2016-05-05"), (1, "acme anvil chips", "2016-05-05"), (2, "Acme", "2016-05-05"), (3, "Acme Old report", "2016-05-05"), (4, "acme old report", "2026-05-05"), (5, "pacme zedd", "2016-05-05"), (6, None, "2016-05-05")]
    found = resolve.match_rules(spark.createDataFrame(texts, "text_id long, text string, day string"), rules)
    rows = {(r.text_id, r.issuer): (r.accepted, r.reason, r.rule_id) for r in resolve.decide(found, F.col("day"), F.lit(True)).collect()}
    assert rows == {
        (0, "acme"): (True, "accepted", "r1"), (1, "acme"): (False, "negative_context", None), (2, "acme"): (False, "missing_required_context", None),
        (3, "acme"): (True, "accepted", "r2"), (4, "acme"): (False, "outside_validity", None),
    }


OBSERVED = "issuer string, source_id string, record_id string, tier string, url string, title string, published_at timestamp_ntz, arrival long"


def seen(spark, *rows):
    full = [(r[0], f"s{i}", "1", r[3] if len(r) > 3 else "discovery", f"https://e{i if len(r) < 5 else r[4]}.org/", r[1], NOW + timedelta(hours=r[2]), i) for i, r in enumerate(rows)]
    return graph.observations(spark.createDataFrame(full, OBSERVED))


def test_near_events(spark):
    rows = seen(spark, ("X", "Acme wins big order", 0), ("X", "Acme wins big order today", 5), ("X", "Correction: Acme wins big order", 6), ("X", "Acme wins big order", 60), ("Y", "Acme wins big order", 1), ("X", "Other", 2), ("X", "Acme wins big order", 0, "discovery", 0))
    found = {r.arrival: (r.event_id, r.version, r.correction_of) for r in graph.near_events(rows).collect()}
    assert found == {0: (0, 1, None), 1: (0, 1, None), 2: (2, 2, 0), 3: (3, 1, None), 4: (4, 1, None), 5: (5, 1, None), 6: (0, 1, None)}


def test_stretches_fold_as_one_run(spark):
    rng = random.Random(8)
    words = "acme wins order chip update 10 12".split()
    rows = seen(spark, *(("X", " ".join(rng.sample(words, 4)), rng.randrange(600)) for _ in range(120)))
    whole = graph.fold_events([r.asDict() for r in rows.collect()])
    got = {r.arrival: (r.event_id, r.version, r.correction_of) for r in graph.near_events(rows).collect()}
    assert got == {r["arrival"]: (r["event_id"], r["version"], r["correction_of"]) for r in whole}


def test_primary_source(spark):
    rows = seen(spark, ("X", "Same", 0, "discovery", 0), ("X", "Same", 0, "primary_regulator", 0), ("X", "Same", 0, "issuer_primary", 0))
    event = graph.exact_events(rows).first()
    want = rows.where("arrival = 1").first().observation_key
    assert event.sources == 3 and event.primary_key == want and event.claim_id.startswith("clm_")


def test_pages(spark):
    frame = spark.createDataFrame([("c", i) for i in (1, 3, 4, 8, 9)], "claim_id string, relation_id long")
    rows = graph.claim_pages(frame, "claim_id", "relation_id", 2).orderBy("relation_id").collect()
    assert [(r.page, r.next_cursor) for r in rows] == [(1, None), (1, 3), (2, None), (2, 8), (3, None)]
    assert [r.relation_id for r in graph.page_after(frame, "c", 3, 2).collect()] == [4, 8, 9]
    with pytest.raises(ValueError):
        graph.page_after(frame, "c", 0, 21)


def test_document_rules(spark):
    rows = documents.classify(spark.createDataFrame(list(enumerate((*documents.PHRASES, None))), "filing_id long, text string")).collect()
    got = {r.filing_id: (r.status, r.rule_id) for r in rows}
    assert got == {
        0: ("matched", "equity_distribution_agreement"), 1: ("no_match", None), 2: ("matched", "share_repurchase_activity"), 3: ("no_match", None),
        4: ("ambiguous", None), 5: ("matched", "filed_prospectus_supplement"), 6: ("no_match", None), 7: ("no_match", None),
    }
    far = "may repurchase " + "x " * 200 + "we repurchased 5 shares"
    assert documents.classify(spark.createDataFrame([(0, far)], "filing_id long, text string")).first().status == "matched"


def test_items(spark):
    row = lambda form, *items: spark.range(1).select(documents.main_item(F.array(*map(F.lit, items))).alias("m"), documents.adverse_signal(F.lit(form), F.array(*map(F.lit, items))).alias("a")).first()
    assert tuple(row("8-K", "9.01", "3.01")) == ("3.01", "delisting") and tuple(row("8-K", "3.01", "2.01", "5.01")) == ("3.01", None)
    assert tuple(row("6-K", "1.03")) == ("1.03", None)


def test_attention_needs_every_day(spark):
    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    posts = spark.createDataFrame([(i, f"{i}{d}{k}", f"u{k}", day(d)) for i in ("full", "gap", "new") for d in range(14) for k in range(1 + d // 7) if not (i == "gap" and d == 3) and not (i == "new" and d < 5)], "issuer string, uri string, author string, ts timestamp_ntz")
    coverage = posts.groupBy("issuer", F.to_date("ts").alias("day")).agg(F.lit(True).alias("adequate"))
    rows = {r.issuer: r for r in signals.attention_change(posts, coverage, F.lit("2024-01-14").cast("date")).collect()}
    assert (rows["full"].posts, rows["full"].prior_posts, rows["full"].authors, rows["full"].strength) == (14, 7, 2, 1.0)
    assert rows["gap"].status == "coverage_gap" and rows["new"].status == "warm_up" and rows["gap"].posts is None


def test_redaction(spark):
    raw = spark.createDataFrame([('{"a": 1, "api-key": "x", "n": {"Cookie": 1, "ok": [1, {"token": 2}]}}',), ("junk",), (None,)], "j string")
    assert [r.x for r in raw.select(redact.redact_nested("j").alias("x")).collect()] == ['{"a":1,"n":{"ok":[1,{}]}}', None, None]
    long = spark.createDataFrame([('{"a": "' + "é" * 990 + '", "b": [' + ", ".join(['"' + "y" * 990 + '"'] * 9) + "]}",)], "j string")
    assert long.select(redact.redact_nested("j").alias("x")).first().x.startswith('{"truncated":true')


def test_digest_ignores_order(spark):
    rows = [("g", i, f"line {i}") for i in range(20)]
    digest = lambda r: operations.order_free_digest(spark.createDataFrame(r, "g string, i long, t string"), ["g"], F.col("t"), "i").first().digest
    assert digest(rows) == digest(rows[::-1]) != digest(rows[:-1])


def test_synthesis(spark):
    from ferrule.operators import synthesis

    columns = "request_id long, ordinal long, family string, signal string, direction string, contribution double, ts timestamp_ntz, change string, event_type string, novelty string, source_records int, corroborating int"
    rows = [
        (1, 0, "insider_trading", "insider_sale_cluster", "bearish", -3.0, NOW, None, "open_market_sale", None, 3, 0),
        (1, 1, "options_flow", "x", "bullish", 2.0, NOW + timedelta(hours=1), "Time to buy calls.", None, None, 1, 1),
        (1, 2, "social", "y", "neutral", 0.0, NOW, None, None, "correction", 1, 2),
    ]
    requests = spark.createDataFrame([(1, "alert_triage", 14, ["technical", "filings_news"]), (2, "research", 14, []), (3, "research", 30, [])], "request_id long, risk_mode string, lookback_days int, missing array<string>")
    one, two, three = synthesis.summaries(spark.createDataFrame(rows, columns), requests).orderBy("request_id").collect()
    assert one.headline == "Options activity: Time to restricted term calls. Observed 2026-07-12T17:00:00+00:00."
    assert one.what_changed == [
        "Multiple insiders reported open-market dispositions.", "The observation is supported by 3 source records.",
        "Time to restricted term calls.", "The canonical event has 1 additional source record.", "Conflicting evidence: Time to restricted term calls.",
    ]
    assert one.why_it_matters.endswith("present: Time to restricted term calls. Confidence remains constrained by missing filings_news, technical.")
    assert one.what_would_invalidate[0].startswith("A later Form 4 amendment") and "conflicting bullish" in one.what_would_invalidate[1] and len(one.what_would_invalidate) == 4
    assert one.next_checks[0].startswith("Verify each Form 4") and one.next_checks[1].startswith("Compare the correction") and len(one.next_checks) == 5
    assert two.headline == synthesis.EMPTY_HEADLINE and two.next_checks[0] == synthesis.CHECK_WIDER and len(two.next_checks) == 3
    assert three.next_checks == [synthesis.CHECK_OPEN, synthesis.CHECK_IDENTITY]


def test_numbers_of_a_hot_key_come_from_many_tasks(spark):
    from ferrule.functions.joins import numbered

    rows = spark.range(4000).select(F.when(F.col("id") % 3 > 0, 1).when(F.col("id") > 100, F.col("id") % 5 + 2).alias("k"), (F.col("id") * 7919 % 4000).alias("o"), F.lit("x").alias("_part"))
    found = numbered(rows.repartition(7), "k", "o", "n", "whole").collect()
    held = {}
    for r in found:
        held.setdefault(r.k, []).append((r.o, r.n, r.whole))
    assert len(found) == 4000
    for rows_of in held.values():
        rows_of.sort()
        assert [n for _, n, _ in rows_of] == list(range(1, len(rows_of) + 1)) and {w for _, _, w in rows_of} == {len(rows_of)}


def test_tickers_of_a_large_or_small_registry_keep_columns(spark, monkeypatch):
    from ferrule.functions import joins

    rows = spark.createDataFrame([(i, t, {"a": i}) for i, t in enumerate(["A", "B.X", "B-X", "none", None, "A"])], "_row int, ticker string, _try map<string,int>")
    registry = spark.createDataFrame([("A", 1, None), ("B-X", 2, "bx")], "ticker string, cik int, name string")
    want = [(0, 1, None), (1, 2, "bx"), (2, 2, "bx"), (3, None, None), (4, None, None), (5, 1, None)]
    for most in (joins.BROADCAST_BYTES, 0):
        monkeypatch.setattr(joins.sized, "__defaults__", (most,))
        found = assembly.by_ticker(rows, registry)
        assert found.columns == ["_row", "ticker", "_try", "cik", "name"]
        assert sorted((r._row, r.cik, r.name) for r in found.collect()) == want


def test_a_long_list_of_collectors_is_refused(spark):
    asked = spark.createDataFrame([(1, "A")], "request_id long, ticker string")
    collectors = spark.range(assembly.MOST_COLLECTORS + 1).select(F.col("id").cast("string").alias("provider"), F.lit("f").alias("family"), F.lit(False).alias("limited"))
    limited = spark.createDataFrame([], "provider string, ticker string")
    with pytest.raises(ValueError, match="collectors"):
        assembly.supported(asked, collectors, limited)
    assert assembly.supported(asked, collectors.limit(3), limited).count() == 3


def test_digests_are_read_one_line_after_another(spark):
    import hashlib

    rows = [("a", 3, "z"), ("a", 1, "x"), (None, 2, "y"), ("b", 1, None), ("b", 2, "q")]
    found = {r.g: (r.lines, r.digest) for r in operations.order_free_digest(spark.createDataFrame(rows, "g string, i long, t string"), ["g"], F.col("t"), "i").collect()}
    h = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert found == {"a": (2, h(h("x") + "\n" + h("z"))), None: (1, h(h("y"))), "b": (2, h(h("q")))}
