"""Exact dedup, sharding and SimHash against plain Python."""

import hashlib
import random
from collections import defaultdict

import pytest
import xxhash

from ferrule.llm import exact_dedup, sharding, simhash
from ferrule.llm.common import components, numbered, read_table

ODD = ["", None, "a", "a b", "A  B", "same text here", "same text here", "x" * 70_000, "é  ü", "Same text here"]


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), seed=42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(ids, prints):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_exact_groups(table, clash):
    found = {r.doc_id: r for r in exact_dedup.exact_groups(clash(table(ODD))).collect()}
    by_text = defaultdict(list)
    for i, t in enumerate(ODD):
        by_text[t or ""].append(i)
    for t, ids in by_text.items():
        for i in ids:
            r = found[i]
            assert (r.keep_id, r.group_size, r.kept) == (max(ids), len(ids), i == max(ids))
            assert r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_exact_groups_repeated_and_empty(spark, table):
    rows = exact_dedup.exact_groups(table(["a", "b"], repeat=[1, 1])).collect()
    assert len(rows) == 4 and sum(r.kept for r in rows) == 2
    assert exact_dedup.exact_groups(table([])).count() == 0
    nulls = spark.createDataFrame([(None, "t"), (None, "t"), (3, "t")], "doc_id long, text string")
    assert sorted(r.kept for r in exact_dedup.exact_groups(nulls).collect()) == [False, False, True]


def test_drop_exact_copies(table, clash):
    left = exact_dedup.drop_exact_copies(clash(table(ODD, repeat=[6, 2])))
    assert sorted(r.doc_id for r in left.collect()) == [1, 2, 3, 4, 6, 7, 8, 9] and "row" in left.columns


def test_levels_of_the_merge_tree(spark):
    docs = spark.range(0, 3000, 1, 70).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', cast(id % 1000 as string)) as text")
    rows = exact_dedup.exact_groups(docs).collect()
    assert {r.keep_id for r in rows if r.doc_id % 3 == 0} == {2997} and sum(r.kept for r in rows) == len({r.keep_id for r in rows})


@pytest.mark.parametrize("limit", [50, 400, 10**9])
def test_shards_fit_and_split_only_where_needed(table, clash, limit):
    rng = random.Random(1)
    texts = ["y" * rng.randrange(50) for _ in range(300)] + [None, ""]
    rows = sharding.extendible_shards(clash(table(texts)), limit).collect()
    assert len(rows) == len(texts)
    size, hashed = defaultdict(int), {r.doc_id: int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) for r in rows}
    for r in rows:
        assert r.prefix == hashed[r.doc_id] >> 60 - r.depth
        size[r.depth, r.prefix] += r.n_bytes
    for r in rows:
        assert size[r.depth, r.prefix] == r.shard_bytes <= limit and not r.oversized
        if r.depth:
            assert sum(x.n_bytes for x in rows if hashed[x.doc_id] >> 61 - r.depth == r.prefix >> 1) > limit


def test_shards_of_one_repeated_key(spark):
    docs = spark.createDataFrame([(7, "z" * 10)] * 100 + [(7, "z" * 90), (8, "u")], "doc_id long, text string")
    rows = sharding.extendible_shards(docs, 64).collect()
    shards = defaultdict(int)
    for r in rows:
        shards[r.depth, r.prefix, r.part] += r.n_bytes
    assert len(rows) == 102 and sum(v > 64 for v in shards.values()) == 1 and sum(r.oversized for r in rows) == 1
    assert all(shards[r.depth, r.prefix, r.part] == r.shard_bytes for r in rows)
    assert sharding.extendible_shards(docs.limit(0), 64).count() == 0


def test_write_shards(spark, table, tmp_path):
    docs = table([str(i) * 5 for i in range(50)])
    sharding.write_shards(docs, sharding.extendible_shards(docs, 64), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50


@pytest.mark.parametrize("text", [None, "", "  \t", "one", "One TWO", "a b c", "a b c a b c a b c", "ÄÖ ä b c d", "w " * 40_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) % 2**64 == plain_fingerprint(text)


def test_near_groups(spark, data, clash):
    docs = read_table(spark, data, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    want = plain_components(sorted(texts), prints)
    found = simhash.near_groups(clash(docs)).collect()
    assert {r.doc_id: r.fingerprint for r in found} == {i: f"{x:016x}" for i, x in prints.items()}
    assert {r.doc_id: r.component_id for r in found} == want and len(set(want.values())) < len(want)


@pytest.mark.parametrize("long_posting", [1, 64])
def test_links_of_close_fingerprints(spark, monkeypatch, long_posting):
    monkeypatch.setattr(simhash, "LONG_POSTING", long_posting)
    rng = random.Random(5)
    prints = []
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(12):
            prints.append(x)
            x ^= sum(1 << b for b in rng.sample(range(64), rng.choice((1, 2, 3, 4))))
    prints = list(dict.fromkeys(prints))
    signed = [(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(prints)]
    found = components(simhash.links(spark.createDataFrame(signed, "fp long, node long")))
    want = plain_components(range(len(prints)), dict(enumerate(prints)))
    got = {r.node: r.component for r in found.collect()}
    assert {i: got.get(i, i) for i in want} == want


def test_near_groups_of_odd_rows(spark, table):
    rows = simhash.near_groups(table(ODD, repeat=[5])).collect()
    assert len(rows) == len(ODD) + 1
    assert {r.doc_id: r.component_id for r in rows}[6] == 5 and {r.doc_id: r.component_id for r in rows}[1] == 0
    assert simhash.near_groups(table([])).count() == 0
    left = simhash.drop_near_copies(table(ODD))
    assert {0, 5} <= {r.doc_id for r in left.collect()} and left.columns == table([]).columns


def test_components_of_a_path(spark):
    edges = spark.range(300).selectExpr("id as a", "id + 1 as b")
    assert {r.component for r in components(edges).collect()} == {0}
    assert components(edges.limit(0)).count() == 0


def test_numbered(spark):
    df = spark.range(2000).selectExpr("cast(if(id % 3 = 0, id % 7, 9) as int) as size", "id")
    rows = numbered(df, 6, "size", "id", by="size").collect()
    groups = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["size"], r["id"])):
        groups[r["size"]].append(r["rank"])
    assert all(v == list(range(len(v))) for v in groups.values()) and len(rows) == 2000


def test_a_small_posting_among_many_is_not_hot(spark, monkeypatch):
    from pyspark.sql import functions as F

    from ferrule.llm import common

    asked = []
    monkeypatch.setattr(simhash, "join_groups", lambda *a: asked.append(a) or common.join_groups(*a))
    n = F.col("id")
    low = F.when(n < 20, n * 2**32).when(n < 8020, F.floor(n / 2) + 100 + n % 2 * 2**32).otherwise(n + 100_000)
    entries = spark.range(30_000).select(n.alias("node"), low.cast("long").alias("fp"), F.lit(15).alias("shared"))
    assert simhash.met(entries).count() == 8020
    found = common.join_groups(*asked[0])
    found.collect()
    ran = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "LeftAnti" not in ran
