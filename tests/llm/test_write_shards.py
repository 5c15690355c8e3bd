"""Shards that are written hold each row once, whatever its key."""

from collections import Counter

from ferrule.llm import sharding


def test_null_and_repeated_keys(spark, tmp_path):
    rows = [(None, "n" * (i % 7)) for i in range(40)] + [(7, "r" * (i % 5 + 1)) for i in range(60)] + [(7, "R" * 90), (None, None), (8, None)] + [(100 + i, f"{i}" * 3) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    shards = sharding.extendible_shards(docs, 64)
    want = {f"{r.depth}-{r.prefix}-{r.part}": r.shard_bytes for r in shards.collect()}
    sharding.write_shards(docs, shards, str(tmp_path / "out"))
    found = spark.read.parquet(str(tmp_path / "out")).collect()
    assert Counter((r.doc_id, r.text) for r in found) == Counter(rows)
    held = Counter()
    for r in found:
        held[r.shard] += len(r.text or "")
    assert dict(held) == want and len([s for s in want if not s.endswith("-0")]) > 4


def test_clashing_names(spark, tmp_path):
    rows = [(i % 7, "t" * (i % 9), f"a{i}", f"b{i}", f"c{i}", f"d{i}", f"e{i}") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string, _key string, _row string, _alike string, _last string")
    shards = sharding.extendible_shards(docs, 64)
    sharding.write_shards(docs, shards, str(tmp_path / "out"))
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.columns == [*docs.columns, "shard_"]
    assert Counter(map(tuple, found.select(*docs.columns).collect())) == Counter(rows)
    assert {r.shard_ for r in found.collect()} == {f"{r.depth}-{r.prefix}-{r.part}" for r in shards.collect()}
