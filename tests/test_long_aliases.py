"""Aliases of any number of words, and titles that name an issuer."""

from ferrule.operators import resolve

SCHEMA = "issuer string, rule_id string, alias string, required array<string>, negative array<string>, valid_from string, valid_to string"


def test_long_aliases_match(spark):
    rules = [("x", f"r{n}", " ".join(f"w{i}" for i in range(n)), [], [], None, None) for n in (1, 3, 4, 5, 9)]
    texts = [(n, "a " + " ".join(f"w{i}" for i in range(n)) + " z") for n in range(11)]
    found = resolve.match_rules(spark.createDataFrame(texts, "text_id long, text string"), spark.createDataFrame(rules, SCHEMA)).select("text_id", "rule_id").collect()
    assert sorted(map(tuple, found)) == sorted((n, f"r{k}") for n in range(11) for k in (1, 3, 4, 5, 9) if n >= k)


def test_aligned_titles(spark):
    rules = [("acme", "r1", "Acme", [], ["anvil"], None, "2018-01-01"), ("zed", "z1", "Zed Holdings of North East", [], [], None, None)]
    tickers = [("acme", "ACM"), ("zed", "Z"), ("zed", "ZD.A")]
    titles = [
        (0, "Acme rises", "2016-05-05"), (1, "Acme anvil", "2016-05-05"), (2, "Acme rises", "2026-05-05"), (3, "Buy (ACM) anvil", "2026-05-05"), (4, "Z wins", "2016-05-05"),
        (5, "zd-a up", "2016-05-05"), (6, "The Zed Holdings of North East", "2016-05-05"), (7, None, "2016-05-05"), (8, "acme", None), (9, "pacme", "2016-05-05"),
    ]
    found = resolve.aligned_titles(spark.createDataFrame(titles, "text_id long, title string, day string"), spark.createDataFrame(rules, SCHEMA), spark.createDataFrame(tickers, "issuer string, ticker string"))
    assert sorted(map(tuple, found.collect())) == [(0, "acme"), (3, "acme"), (5, "zed"), (6, "zed"), (8, "acme")]


def test_only_words_that_begin_an_alias_become_rows(spark):
    texts = spark.createDataFrame([(1, "Big bad Wolf of the North"), (2, "wolfram"), (3, None), (4, ""), (5, "bad wolf")], "text_id long, text string")
    rules = spark.createDataFrame([("a", "w", "bad wolf", None, None, None, None), ("b", "n", "Wolf of the north", None, None, None, None)], SCHEMA)
    found = resolve.match_rules(texts, rules)
    assert {(r.text_id, r.rule_id) for r in found.collect()} == {(1, "w"), (1, "n"), (5, "w")}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" in plan and "array_distinct" not in plan


def test_many_aliases_match_as_few_do(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "Big bad Wolf of the North"), (2, "wolfram"), (3, None)], "text_id long, text string")
    rules = spark.createDataFrame([("a", "w", "bad wolf", None, None, None, None), ("b", "n", "Wolf of the north", None, None, None, None)], SCHEMA)
    few = sorted(map(str, resolve.match_rules(texts, rules).select("text_id", "rule_id", "body").collect()))
    monkeypatch.setattr(resolve, "FEW_HEADS", 1)
    assert few == sorted(map(str, resolve.match_rules(texts, rules).select("text_id", "rule_id", "body").collect())) and len(few) == 2


def test_texts_are_normalised_once(spark):
    """No condition in the plan carries a second copy of what is done to texts."""
    texts = spark.createDataFrame([(1, "one of the two", "t")], "text_id long, text string, title string")
    rules = spark.createDataFrame([("i", "r", "of the", ["one"], ["three"], None, None)], "issuer string, rule_id string, alias string, required array<string>, negative array<string>, valid_from string, valid_to string")
    found = resolve.match_rules(texts, rules)
    lines = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert not [x for x in lines if "Filter" in x and "regexp_replace" in x and "alias#" not in x]
    assert [(r.text_id, r.required_met, r.negative_met) for r in found.collect()] == [(1, ["one"], [])]
