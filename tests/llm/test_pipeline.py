"""The corpus pipeline against plain Python, stage by stage, and on odd tables."""

import zlib

import pytest

import corpus_pipeline
from ferrule.llm.common import read_table
from ferrule.llm.quality import score_quality
from test_dedup_and_sharding import plain_components, plain_fingerprint
from test_spans import PII, plain


def redacted(text):
    out, last, name = [], 0, None
    for kind, a, b in sorted(plain(PII, text), key=lambda s: (s[1], s[2], s[0])):
        if name is not None and a < last:
            last = max(last, b)
            continue
        out += [text[last:a], f"<{kind.upper()}>"]
        last, name = b, kind
    return "".join(out) + text[last:]


def test_pipeline_by_plain_python(spark, data):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = read_table(spark, data, "documents")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    good = {r.doc_id for r in score_quality(docs, read_table(spark, data, "labels")).collect() if r.predicted}
    assert 0 < len(good) < len(texts)
    last = {t: i for i, t in sorted((i, texts[i]) for i in good)}
    last = {t: max(i for i in good if texts[i] == t) for t in last}
    prints = {i: plain_fingerprint(texts[i]) for i in last.values()}
    kept = {i for i, c in plain_components(sorted(prints), prints).items() if i == c}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for i in kept:
        ids = np.array([*tokenizer.encode(redacted(texts[i]), add_special_tokens=False).ids, 1], "<u4")
        for n, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[i, n] = (at, len(part), zlib.crc32(part.tobytes()))
    rows = corpus_pipeline.run(spark, data).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in held.values():
        ends = [0, *(a + n for a, n in sorted(places))]
        assert [a for a, _ in sorted(places)] == ends[:-1] and ends[-1] <= 4096


@pytest.mark.parametrize("texts", [[], [None, "", "a b c", "a b c"]])
def test_pipeline_of_odd_tables(spark, table, tmp_path, texts):
    table(texts, repeat=[2] if texts else []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in rows) == ([1, 3] if texts else [])
