"""Nested redaction: order, bounds and depth."""

import json

import pytest

from ferrule.operators import redact


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ('{"b": "}]", "a": [1.50, true, null, {"x": "\\""}]}', '{"b":"}]","a":[1.50,true,null,{"x":"\\""}]}'),
        ('{"pass-word": 1, "Password": {"a": [1, {}]}, "k": 2}', '{"k":2}' if "pass_word" in redact.SENSITIVE else '{"pass-word":1,"k":2}'),
        ("[]", "[]"), ("7", "7"), ('"x"', '"x"'), ('{"a": {}}', '{"a":{}}'),
        ("[[[[[[1], 2]]]]]", '[[[[["[maximum depth reached]","[maximum depth reached]"]]]]]'),
    ],
)
def test_rewritten(raw, want):
    assert redact.rewritten(raw) == want and json.loads(want) is not Ellipsis


def test_bounds():
    assert len(json.loads(redact.rewritten(json.dumps(list(range(80)))))) == redact.MAX_ITEMS
    assert len(json.loads(redact.rewritten(json.dumps({"é" * 1200: "ü" * 1200})))["é" * 1000]) == redact.MAX_TEXT
    kept = json.loads(redact.rewritten(json.dumps({("token" if i < 10 else "k") + str(i): i for i in range(80)})))
    assert len(kept) == redact.MAX_ITEMS - 10


def test_preview(spark):
    row = spark.createDataFrame([("[" + ", ".join(['"' + "é" * 900 + '"'] * 9) + "]",)], "j string").select(redact.redact_nested("j").alias("x")).first()
    found = json.loads(row.x)
    assert found["truncated"] is True and 7490 <= len(found["preview"].encode()) <= 7500 and found["preview"].endswith("é")
