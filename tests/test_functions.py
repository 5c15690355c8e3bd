"""Column functions on the cases their rules name."""

import random

import pytest
from pyspark.sql import functions as F

from ferrule.functions import keys, numbers, text, urls


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("given, want", [("NVIDIA & Partners: Q2 +10%", "nvidia and partners q2 10%"), ("Привет, мир!", "привет мир"), ("Straße", "strasse"), ("  ", "")])
def test_titles(spark, given, want):
    assert one(spark, text.normalize_title(F.lit(given))) == want


def test_entities_and_phrases(spark):
    assert one(spark, text.normalize_entity(F.lit("A_b,  C's"))) == "a_b c s"
    assert one(spark, text.has_phrase(F.lit("a bc d"), F.lit("bc"))) and not one(spark, text.has_phrase(F.lit("a bc d"), F.lit("b"))) and not one(spark, text.has_phrase(F.lit("a"), F.lit("")))


def test_warnings_and_safe_text(spark):
    assert one(spark, text.sanitize_warning(F.lit("bad\x07 Token: abc api-key=1"))) == "bad Token=[redacted] api-key=[redacted]"
    assert one(spark, text.safe_text(F.lit("Buy alpha, buyer"))) == "restricted term restricted term, buyer"


@pytest.mark.parametrize(
    "given, want",
    [
        ("https://Example.com//news/item/?b=2&utm_source=rss&a=1#section", "https://example.com/news/item?a=1&b=2"),
        ("https://example.com", "https://example.com/"), ("https://example.com.:443/x", "https://example.com/x"), ("https://example.com:8443/x//", "https://example.com:8443/x"),
        ("http://example.com/", None), ("https:///x", None), ("https://e.org/?a=&ref=1&a=b+c", "https://e.org/?a=&a=b+c"), (None, None),
    ],
)
def test_urls(spark, given, want):
    assert one(spark, urls.canonical_url(F.lit(given).cast("string"))) == want


def test_host_suffixes(spark):
    assert one(spark, urls.host_suffixes(F.lit("a.b.c"))) == ["a.b.c", "b.c", "c"]
    assert one(spark, urls.host(F.lit("https://u:p@WWW.Ex.org:80/x"))) == "www.ex.org"


def test_keys(spark):
    import hashlib

    assert one(spark, keys.hash_key(F.lit("a"), F.lit(None), F.lit(3))) == hashlib.sha256(b"a\x1f\x1f3").hexdigest()
    stamp = lambda s: one(spark, keys.iso_utc(F.to_timestamp_ntz(F.lit(s))))
    assert stamp("2024-01-02 03:04:05") == "2024-01-02T03:04:05+00:00" and stamp("2024-01-02 03:04:05.12") == "2024-01-02T03:04:05.120000+00:00"


def test_numbers(spark):
    assert one(spark, numbers.wilson_lower(F.lit(0), F.lit(0))) == 0 and 0.40 < one(spark, numbers.wilson_lower(F.lit(50), F.lit(100))) < 0.43
    assert [one(spark, numbers.finite(F.lit(x))) for x in ("1.5", "x", "NaN", "Infinity")] == [1.5, None, None, None]


def plain_subsequence(x, y):
    row = [0] * (len(y) + 1)
    for a in x:
        last = 0
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], last + 1 if a == b else max(row[j], row[j - 1])
    return row[-1]


def test_token_set_ratio():
    rng = random.Random(2)
    for _ in range(300):
        x, y = ("".join(rng.choice("ab c") for _ in range(rng.randrange(1, 14))) for _ in range(2))
        assert text._common_subsequence(x, y) == plain_subsequence(x, y)
    assert text.token_set_ratio("a b", "b a c") == 100 and text.token_set_ratio("", "a") == 0 and text.token_set_ratio("ab", "cd") == 0
    assert text.token_set_ratio("acme wins large order", "acme wins large orders") > 92


def test_folding_is_that_of_every_code_point(spark):
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(c, f"a{chr(c)}b") for c in points], "c long, t string").repartition(8)
    import unicodedata

    wrong = [r.c for r in rows.select("c", text.fold(F.col("t")).alias("f")).where("f is not null").collect() if r.f != f"a{chr(r.c)}b".casefold() and unicodedata.category(chr(r.c)) != "Cn"]
    assert wrong == []
    words = ["ΟΔΟΣ ΣΑΣ", "Straße GROẞ", "İstanbul ﬁne ŉ", "ᏣᎳᎩ", "", None]
    found = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.fold(F.col("w")).alias("f")).collect()
    assert [r.f for r in found] == [w and w.casefold() for w in words]
