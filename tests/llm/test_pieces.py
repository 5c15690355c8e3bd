import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from ferrule.llm import pieces
from ferrule.llm.queries import QUERIES

PATH = public_tokenizers.path(pieces.MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(library, texts):
    return [library.encode(t or "") for t in texts]


ODD = [
    "", " ", "  ", " a", "a ", " a  b   c    d" + " " * 40 + "e ", "▁", "a▁▁b", "x" * 70, "the" * 5000, " " * 3000, "日本語" * 50, "\x00a\x01\n\t", "😤é́ﬁ�",
    "<s> </s> <unk> <0x41>", "a b　c​d", "hello world", "hello world", None,
]


def test_odd_texts(spark, table, clash, library):
    rows = pieces.encode_pieces(clash(table(ODD, repeat=(3, 3)))).collect()
    assert len(rows) == len(ODD) + 2
    for r in rows:
        assert r.ids == library.encode(ODD[r.doc_id] or "")
    found = {r.doc_id: r for r in pieces.piece_digests(table(ODD)).collect()}
    for i, ids in enumerate(expected(library, ODD)):
        assert (found[i].n_tokens, found[i].ids_sha256, found[i].decoded_sha256) == (len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids)))


def test_empty_table(table):
    assert pieces.piece_digests(table([])).count() == 0


def test_null_key(spark, library):
    docs = spark.createDataFrame([(None, "ab cd"), (2**53 + 1, None)], "doc_id long, text string")
    assert {(r.doc_id, tuple(r.ids)) for r in pieces.encode_pieces(docs).collect()} == {(None, tuple(library.encode("ab cd"))), (2**53 + 1, ())}


def test_random_texts(library):
    model, rnd = pieces.piece_model(PATH), random.Random(5)
    texts = ["".join(rnd.choice("ab the in▁ \n\té日½x<>0😤\x00") for _ in range(rnd.randint(0, 200))) for _ in range(2000)]
    ids, sizes = model.encode(pa.array(texts, pa.large_string()))
    at = 0
    for text, size, want in zip(texts, sizes, library.encode(texts)):
        assert ids[at : at + size].tolist() == want, text
        assert model.decode(want) == library.decode(want)
        at += size
    assert at == len(ids)


def test_any_ids_decode_as_the_library_does(library):
    model, rnd = pieces.piece_model(PATH), random.Random(6)
    marker = library.piece_to_id("▁")
    for _ in range(3000):
        ids = [rnd.choice([rnd.randrange(32000), rnd.randrange(3, 259), rnd.randrange(3), marker, marker]) for _ in range(rnd.randint(0, 12))]
        assert model.decode(ids) == library.decode(ids), ids


def test_each_distinct_chunk_is_segmented_once(monkeypatch):
    model, seen = pieces.PieceModel(PATH), []
    segment = model.segment
    monkeypatch.setattr(model, "segment", lambda chunks: seen.extend(chunks) or segment(chunks))
    model.encode(pa.array(["one two  two one two", "two"] * 50, pa.large_string()))
    assert len(seen) == len(set(seen))
    assert {"▁one", "▁two", "▁▁two"} <= set(seen)


def test_small_blocks_give_the_same(spark, data, library, monkeypatch):
    monkeypatch.setattr(pieces, "BLOCK_BYTES", 1000)
    monkeypatch.setattr(pieces, "SLAB", 50)
    model = pieces.PieceModel(PATH)
    texts = [r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").limit(20).collect()]
    ids, sizes = model.encode(pa.array(texts, pa.large_string()))
    assert ids.tolist() == [i for t in library.encode(texts) for i in t]


def test_a_model_whose_pieces_cross_markers_is_refused(monkeypatch):
    class Crossing:
        def __init__(self, model_file):
            self.inner = sentencepiece._Processor(model_file=model_file)

        def __getattr__(self, name):
            return getattr(self.inner, name)

        def id_to_piece(self, i):
            return "a▁b" if i == 300 else self.inner.id_to_piece(i)

    monkeypatch.setattr(sentencepiece, "_Processor", sentencepiece.SentencePieceProcessor, raising=False)
    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Crossing)
    with pytest.raises(ValueError, match="marker"):
        pieces.PieceModel(PATH)


def test_whole_table(spark, data, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    found = QUERIES["op11_piece_bpe"](spark, data).collect()
    assert len(found) == len(docs)
    for r in found:
        ids = library.encode(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids)))
