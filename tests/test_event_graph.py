"""The event graph in rounds gives what the fold in order of arrival gives."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ferrule.functions.text import token_set_ratio
from ferrule.operators import graph, near_titles

NOW = datetime(2026, 7, 12, 16)
SCHEMA = "issuer string, source_id string, record_id string, tier string, url string, title string, published_at timestamp_ntz, arrival long"


def seen(spark, rows):
    """rows: (issuer, title, hours, url)."""
    full = [(i, f"s{n}", "1", "discovery", f"https://e{u}.org/", t, NOW + timedelta(hours=h), n) for n, (i, t, h, u) in enumerate(rows)]
    return graph.observations(spark.createDataFrame(full, SCHEMA)).repartition(4)


def folded(observed):
    out = {}
    by_issuer = {}
    for r in observed.collect():
        by_issuer.setdefault(r.issuer, []).append(r.asDict())
    for rows in by_issuer.values():
        for r in graph.fold_events(rows):
            out[r["arrival"]] = (r["issuer"], r["event_id"], r["version"], r["correction_of"], r["exact"])
    return out


def placed(observed, last_rows):
    found = graph.near_events(observed, last_rows).collect()
    assert len({r.arrival for r in found}) == len(found)
    return {r.arrival: (r.issuer, r.event_id, r.version, r.correction_of, r.exact) for r in found}


def near_copies(rnd, count, hours, words, numbers):
    """Titles of a few families, with typing errors, dropped words, other numbers and announced corrections."""
    out = []
    for _ in range(count):
        title = rnd.choice(words)
        if rnd.random() < 0.3:
            title = title.replace(rnd.choice(title), rnd.choice("abc"), 1)
        if rnd.random() < 0.2:
            title = " ".join(rnd.sample(title.split(), len(title.split())))
        if rnd.random() < 0.3:
            title += f" {rnd.choice(numbers)}"
        if rnd.random() < 0.1:
            title = "Update: " + title
        out.append((rnd.choice("XXXY"), title, rnd.uniform(0, hours), rnd.choice([1, 1, 2, 3, rnd.randrange(50)])))
    return out


FAMILIES = ["Acme wins a big order from the navy", "Acme wins a big order from the army", "Chip maker opens new plant in Ohio", "Dividend raised again by board of directors"]


@pytest.mark.parametrize("last_rows", [0, 60, graph.LAST_ROWS])
def test_random_rows_as_the_fold_has_them(spark, last_rows):
    observed = seen(spark, near_copies(random.Random(last_rows + 1), 90, 200, FAMILIES[:3], [1, 2]))
    assert placed(observed, last_rows) == folded(observed)


def test_many_random_rows_end_in_one_fold(spark):
    observed = seen(spark, near_copies(random.Random(5), 600, 900, FAMILIES, [1, 2, 30]))
    assert placed(observed, graph.LAST_ROWS) == folded(observed)


def test_one_title_of_all_rows_takes_few_rounds(spark, monkeypatch):
    rnd = random.Random(6)
    observed = seen(spark, [("X", FAMILIES[0], rnd.uniform(0, 140), rnd.randrange(200)) for _ in range(400)])
    rounds = []
    best = graph._best
    monkeypatch.setattr(graph, "_best", lambda *a: rounds.append(1) or best(*a))
    assert placed(observed, 0) == folded(observed)
    assert len(rounds) <= 12


def test_one_key_and_one_announced_title_of_all_rows(spark):
    rnd = random.Random(7)
    rows = [("X", FAMILIES[0], rnd.uniform(0, 100), 1) for _ in range(100)] + [("X", "Correction: " + FAMILIES[0], rnd.uniform(0, 100), rnd.randrange(9)) for _ in range(60)]
    rnd.shuffle(rows)
    observed = seen(spark, rows)
    assert placed(observed, 0) == folded(observed)


def test_a_copy_may_leave_what_its_first_joined(spark):
    observed = seen(spark, [("X", FAMILIES[0], 0, 1), ("X", FAMILIES[0] + " today", 10, 2), ("X", FAMILIES[0] + " today", 90, 2), ("X", FAMILIES[0] + " today", 11, 2)])
    assert placed(observed, 0) == folded(observed) == {0: ("X", 0, 1, None, False), 1: ("X", 0, 1, None, False), 2: ("X", 2, 1, None, False), 3: ("X", 2, 1, None, True)}


def test_empty_table(spark):
    assert graph.near_events(seen(spark, [("X", "a", 0, 0)]).limit(0)).count() == 0


def test_versions_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(21)], "event_id long, correction_of long")
    assert {r.event_id: r.version for r in graph._versions(chain).collect()} == {i: i + 1 for i in range(21)}


def test_no_pair_of_titles_is_lost(spark):
    """All pairs, of short and long words, one letter apart, with words added, dropped and doubled, against comparing all with all."""
    rnd = random.Random(11)
    words = ["a", "b", "of", "to", "acme", "acmes", "orders", "order", "navy", "dividend", "dividends", "raised", "é", "10", "10%", "über", "x" * 30]
    titles = set()
    while len(titles) < 150:
        base = [rnd.choice(words) for _ in range(rnd.randint(1, 9))]
        titles.add(" ".join(base))
        word = rnd.randrange(len(base))
        base[word] = base[word][: rnd.randint(1, len(base[word]))] + rnd.choice(["", "s", "xy"])
        titles.add(" ".join(base))
    titles = sorted(titles)
    table = spark.createDataFrame([("X", f"k{n:03}", t, n % 2) for n, t in enumerate(titles)], "issuer string, key string, title string, span long")
    found = {(r.a, r.b): (r.ratio, r.corrects) for r in near_titles.title_pairs(table).collect()}
    want = {}
    for i, one in enumerate(titles):
        for j, two in enumerate(titles):
            if i != j and (ratio := token_set_ratio(one, two)) >= near_titles.NEAR_RATIO:
                want[f"k{i:03}", f"k{j:03}"] = (ratio, near_titles.Wording.of(two).corrects(near_titles.Wording.of(one)))
    assert found == want and len(want) > 100


def test_titles_far_apart_do_not_meet(spark):
    table = spark.createDataFrame([("X", "a", "one two", 0), ("X", "b", "one two three", 2), ("Y", "c", "one two", 0)], "issuer string, key string, title string, span long")
    assert near_titles.title_pairs(table).count() == 0
    assert near_titles.title_pairs(table.withColumn("span", F.lit(1).cast("long"))).count() == 2


def test_few_titles_of_a_span_are_compared_without_grams(spark, monkeypatch):
    """As by what they share, and without a row for each run of characters of each title."""
    rnd = random.Random(5)
    rows = [(i % 2, f"k{i}", f"{rnd.choice(('acme', 'widget'))} opens plant number {i % 3} in the north of town", rnd.randrange(6)) for i in range(60)]
    table = spark.createDataFrame(rows, "issuer long, key string, title string, span long")
    every = {tuple(r) for r in near_titles.title_pairs(table, 0).collect()}
    some = {tuple(r) for r in near_titles.title_pairs(table, 15).collect()}
    monkeypatch.setattr(near_titles, "_grams", None)
    pairs = near_titles.title_pairs(table).collect()
    assert len(pairs) == len({(r.a, r.b) for r in pairs}) > 0
    assert {tuple(r) for r in pairs} == every == some


def test_observations_are_made_once_for_all_tables(spark):
    """No table of the store goes back to what it was made from, and each row's title is normalised once."""
    from ferrule.operators import event_store

    observed = seen(spark, [("i", f"title {n % 4}", n, n % 3) for n in range(20)])
    assert observed._jdf.queryExecution().optimizedPlan().toString().count("AS normal_title") <= 1
    tables = event_store.event_tables(observed)
    for table in (tables.observations, tables.events, tables.links, tables.claims, tables.claim_sources):
        plan = table._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "utm_" not in plan
