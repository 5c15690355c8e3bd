"""Ids beside nulls, and columns of any name, in all operators and in the pipeline's stages."""

import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ferrule.llm import byte_bpe, exact_dedup, flac, packing, pii, quality, secret_scan, sharding, simhash, url_filter
from ferrule.llm.common import drop_rows, map_frames

BIG = 2**53 + 1
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside themselves, in any of their frames.
NAMES = (
    "_id", "_score", "_found", "_spans", "_row_sha", "_sha", "_base", "_more", "_key", "row", "row_number", "found", "score", "node", "fp", "sha", "bytes",
    "check", "copies", "digest", "best", "kept", "keep_id", "shared", "posting", "h", "leaf", "y", "vector", "held_out", "piece", "rank", "sequence_id", "media",
)
TEXTS = ["mail a@b.cd now please", "one two three four", "", None, "one two three four", "x"]


@pytest.fixture(scope="module")
def docs(spark):
    """Rows with ids that floats can't hold beside null ids, a repeated row, and columns of all these names."""
    ids = [BIG, BIG + 2, None, 7, None, -BIG]
    rows = [(i, t, "en", "s", 1) for i, t in zip(ids, TEXTS)]
    return spark.createDataFrame([*rows, rows[1]], SCHEMA).coalesce(1).withColumns({n: F.lit("kept as it is") for n in NAMES})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(BIG, 1, 0), (BIG + 2, 1, 0), (7, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")


WANT = sorted([BIG, BIG + 2, BIG + 2, None, 7, None, -BIG], key=str)
OPERATORS = {
    "op2": lambda d, n: simhash.near_groups(d),
    "op3": lambda d, n: sharding.extendible_shards(d, 100),
    "op4": lambda d, n: exact_dedup.exact_groups(d),
    "op5": lambda d, n: pii.find_pii(d),
    "op6": lambda d, n: packing.pack_documents(d),
    "op7": lambda d, n: quality.score_quality(d, n),
    "op8": lambda d, n: secret_scan.find_secrets(d, F.col("lang"), F.col("source")),
    "op9": lambda d, n: byte_bpe.token_digests(d),
    "op10": lambda d, n: flac.media_facts(flac.media_column(d)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_ids_survive_beside_nulls(docs, labels, name):
    found = OPERATORS[name](docs, labels).collect()
    assert sorted((r.doc_id for r in found), key=str) == WANT
    if name == "op7":
        assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    if name == "op2":
        assert {r.component_id for r in found if r.doc_id in (BIG + 2, None)} == {BIG + 2, 7}
    if name == "op4":
        assert {r.doc_id: r.keep_id for r in found if r.doc_id is not None} == {BIG: BIG, BIG + 2: BIG + 2, 7: 7, -BIG: -BIG}
        assert sum(r.kept for r in found) == 4


def test_urls_of_any_id(spark):
    pages = spark.createDataFrame([(BIG, "http://a.net/x", None), (None, None, None), (BIG, "http://a.net/x", None)], "page_id long, url string, html string")
    found = url_filter.judge_urls(pages.withColumns({n: F.lit("x") for n in (*NAMES, "host", "path", "fit", "trust", "salt")}))
    assert sorted((r.page_id for r in found.collect()), key=str) == [BIG, BIG, None]


@pytest.mark.parametrize(("stage", "left"), [("quality", WANT), ("exact_dedup", [BIG, BIG + 2, 7, -BIG]), ("near_dedup", [BIG, BIG + 2, 7, -BIG, None, None, BIG + 2]), ("pii", WANT)])
def test_stages_keep_columns(spark, docs, labels, tmp_path, stage, left):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    kept = dict(corpus_pipeline.STAGES)[stage](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted((r.doc_id for r in rows), key=str) == sorted(left, key=str)
    assert all(r[n] == "kept as it is" for r in rows for n in NAMES)


def test_pieces_of_the_pipeline(spark, docs, tmp_path):
    rows = dict(corpus_pipeline.STAGES)["packing"](spark, docs, str(tmp_path)).collect()
    assert sorted((r.doc_id for r in rows), key=str) == WANT


def test_map_frames_and_drop_rows(spark):
    df = spark.createDataFrame([(BIG, 1, "a", 0.5, True), (None, None, None, None, None)], "a long, b int, c string, d double, e boolean").coalesce(1)
    same = map_frames(df, lambda frames: frames, "a long, b int, c string, d double, e boolean")
    assert sorted(same.collect(), key=str) == sorted(df.collect(), key=str)
    assert [r.a for r in drop_rows(df, spark.createDataFrame([(BIG,)], "a long"), "a").collect()] == [None]
