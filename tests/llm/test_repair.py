import random

import brute_repair as brute
import pytest
from pyspark.sql import functions as F

from ferrule.llm import repair
from ferrule.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"
ROLES = ("user", "assistant", "system", "tool", "")


def turns(rnd, size):
    rows = [(n, rnd.choice(ROLES), "x") for n in range(size)]
    return rows, [rnd.choice(["", "", "t", "b", "d"]) for _ in rows]


def chained(rows, marks, size):
    """(cost, audit) by charts of segments of this size."""
    parts = [repair.charts(tuple((r[1][:1], m) for r, m in zip(rows[i : i + size], marks[i : i + size]))) for i in range(0, len(rows), size)]
    chain = repair.Chain()
    for p in parts:
        chain.add(p)
    cost, tail, ways = chain.ways()
    return cost, "".join(next(a for e, l, _, a in p if (e, l) == w) for p, w in zip(parts, ways)) + tail


def test_plain_states_agree_with_every_sequence_of_edits():
    rnd = random.Random(3)
    for n in range(200):
        rows, marks = turns(rnd, n % 4)
        assert brute.best(rows, marks)[:2] == brute.every_way(rows, marks), (rows, marks)


def test_charts_of_segments_agree_with_plain_states():
    rnd = random.Random(4)
    for _ in range(400):
        rows, marks = turns(rnd, rnd.randint(0, 40))
        for size in (1, 3, 100):
            assert chained(rows, marks, size) == brute.best(rows, marks)[:2], (rows, marks)


def audited(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA)
    return sorted((tuple(r) for r in repair.audit_conversations(repair.damaged(table), table).collect()), key=repr)


def test_whole_table(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = sorted(tuple(r) for r in QUERIES["op12_conversation_repair"](spark, data).collect())
    assert found == sorted(brute.whole(rows))


def test_odd_rows(spark):
    rows = [
        (1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 1, "assistant", None), (1, None, None, "a."), (1, None, "", "b!"), (1, 5, "user", "no end"), (1, 9, "admin", "Yes.\n\t"),
        (None, 1, "user", "A?"), (None, 2, "assistant", " "), (2, None, "user", "x."), (3, 7, None, None), (4, 1, "user", "long. " * 30000), (4, 2, "assistant", "B."),
        (2**53 + 1, 2**53 + 1, "user", "z."), (2**53 + 1, 2**53 + 3, "assistant", "z."),
    ]
    assert audited(spark, rows) == sorted(brute.whole(rows), key=repr)


def test_small_segments_and_a_hot_conversation(spark, monkeypatch):
    monkeypatch.setattr(repair, "SEGMENT", 7)
    rnd = random.Random(9)
    words = ["Yes.", "No!", "", "Well", "So?", "And.", "But."]
    rows = [(rnd.choice([0, 0, 0, rnd.randint(1, 30)]), rnd.choice([None, *range(300)]), rnd.choice(ROLES[:3]), rnd.choice(words) + (str(n) + "." if n % 2 else "")) for n in range(900)]
    assert audited(spark, rows) == sorted(brute.whole(rows), key=repr)


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "user", "Q?"), (1, 2, "tool", "A."), (1, 3, "user", "Q?"), (1, 4, "user", "R?")]
    table = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("key", "pos", "seg", "fault", "edit", "same", "initial")})
    found = repair.repair_conversations(table).orderBy("pos", "place").collect()
    assert [(r.conv_id, r.edit, r.role, r.text) for r in found] == [
        (1, "K", "system", "S."), (1, "K", "user", "Q?"), (1, "R", "assistant", "A."), (1, "K", "user", "R?"), (1, "I", "assistant", "")
    ]


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.repair_conversations(none).count() == 0
    assert repair.audit_conversations(none).count() == 0


def test_conversations_without_rows(spark):
    every = spark.createDataFrame([(7, 0, "user", "x.")], SCHEMA)
    (row,) = repair.audit_conversations(every.where("false"), every).collect()
    assert row.asDict() | {"repaired_sha256": ""} == {
        "conv_id": 7, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": ""
    }
    assert row.repaired_sha256.startswith("e3b0c442")


@pytest.mark.parametrize("marks, want", [((), (0, "")), (("", ""), (0, "KK")), (("b",), (4, "D")), (("t",), (4, "D")), (("",), (3, "KI"))])
def test_worked_costs(marks, want):
    rows = [(n, r, "x") for n, r in enumerate(("user", "assistant")[: len(marks)])]
    assert chained(rows, marks, 512) == want
