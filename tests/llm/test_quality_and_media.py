"""Quality on held-out labels, media by exact round trips and damage."""

import hashlib
import os
import random
import zlib

import numpy as np
import pytest

from ferrule.llm import flac, quality
from ferrule.llm.common import read_table
from ferrule.llm.queries import op7_quality, op10_flac

ODD = ["", None, "a", "é" * 33, "x" * 5000, "ab" * 40_000, " \n\t", "日本語", "THE,!! END!!", "end\x00"]


def test_quality_on_held_out_rows(spark, data):
    rows = {r.doc_id: r for r in op7_quality(spark, data).collect()}
    labels = {r.doc_id: r.quality for r in read_table(spark, data, "labels").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in rows.items())
    held = [i for i in labels if rows[i].held_out]
    assert sum(rows[i].predicted == labels[i] for i in held) >= 0.9 * len(held)


def test_scores_depend_on_texts_alone(spark, table, clash):
    docs = table(["same words here"] * 3 + ODD, repeat=[0])
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(9)] + [(2, None, 0), (99, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality.score_quality(clash(docs), labels).collect()
    assert len(rows) == 14 and len({r.score for r in rows if r.doc_id < 3}) == 1
    assert {r.doc_id: r.score for r in rows}[3] == {r.doc_id: r.score for r in rows}[4]
    kept = quality.keep_good(docs, labels)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.predicted} and kept.columns == docs.columns


def test_without_labels_or_rows(spark, table):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in quality.score_quality(table(["a", None]), none).collect()} == {1}
    assert quality.score_quality(table([]), none).count() == 0 and quality.keep_good(table([]), none).count() == 0


def test_tokens_by_plain_python():
    texts = ["Ab ab 12! ab", None, "", "é##x"]
    word, shape, first = quality.tokens(texts)
    assert first.tolist() == [0, 5, 5, 5] and len(word) == 8
    assert word[0] == word[1] == word[4] and shape[1] & 2 and shape[3] & 1 and not shape[0] & 3
    assert (shape >> 8).tolist() == [1, 1, 2, 3, 1, 1, 3, 1]


def test_context_sums_follow_a_plain_count():
    texts = ["a b", "b c a"]
    word, shape, first = quality.tokens(texts)
    place, sign = quality._index_vectors()
    vector = lambda i: np.bincount(place[i], sign[i], quality.DIM)
    want = np.zeros((quality.WORDS + quality.SHAPES, quality.DIM))
    for a, z in ((0, 2), (2, 5)):
        for i in range(a, z):
            for j in (i - 1, i + 1):
                if a <= j < z:
                    want[word[i]] += vector(word[j])
                    want[quality.WORDS + shape[i]] += vector(quality.WORDS + shape[j])
            for of in (word[i], quality.WORDS + shape[i]):
                want[of] += vector(quality.WORDS + shape[i])
    assert np.allclose(quality.contexts(texts), want)


def test_round_trip():
    rng = random.Random(1)
    payloads = [flac.payload_of(t)[0] for t in ODD] + [os.urandom(64 * n) for n in (1, 3, 64, 65, 200)]
    payloads += [bytes(rng.randrange(97, 123) for _ in range(64 * n)) for n in (1, 2, 64, 100)] + [bytes(64 * 300)]
    media = flac.encode(payloads)
    assert flac.decode(media) == payloads
    for p, m in zip(payloads, media):
        assert flac.encode([p]) == [m] and flac.decode([m]) == [p]


def test_damage_is_found():
    rng = random.Random(7)
    payloads = [flac.payload_of("some text to store " * n)[0] for n in (1, 40, 600)]
    for p, m in zip(payloads, flac.encode(payloads)):
        frames = flac.seek_points(m)[2]
        for _ in range(60):
            at = rng.randrange(frames[0][1], len(m))
            hurt = bytearray(m)
            hurt[at] ^= 1 << rng.randrange(8)
            with pytest.raises(flac.Damaged):
                flac.decode([bytes(hurt)])
    with pytest.raises(flac.Damaged):
        flac.decode([b"RIFF"])


def plain_crc16(data):
    x = 0
    for b in data:
        x ^= b << 8
        for _ in range(8):
            x = (x << 1 ^ (0x8005 if x & 0x8000 else 0)) & 0xFFFF
    return x


def test_frames_by_the_format():
    media = flac.encode([flac.payload_of("plain text " * 900)[0]])[0]
    samples, md5, frames = flac.seek_points(media)
    assert samples == 9920 and [f[0] for f in frames] == [0, 4096, 8192]
    for _, at, size, _ in frames:
        frame = media[at : at + size]
        assert frame[:2] == b"\xff\xf8" and plain_crc16(frame[:-2]) == int.from_bytes(frame[-2:], "big")


def test_media_facts(spark, data, table, clash):
    found = flac.media_facts(flac.media_column(clash(table(ODD, repeat=[2])))).collect()
    assert len(found) == len(ODD) + 1
    texts = dict(enumerate(ODD))
    for r in [*found, *(rows := op10_flac(spark, data).collect())]:
        if r in rows:
            continue
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:]) and r.feature.startswith(f"samples={len(payload)};")
    docs = {r.doc_id: (r.text or "").encode() for r in read_table(spark, data, "documents").collect()}
    for r in rows:
        raw = docs[r.doc_id]
        assert r.payload_sha256 == hashlib.sha256(raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))).hexdigest()
    assert found[0].media_sha256 == found[1].media_sha256 or ODD[found[0].doc_id] != ODD[found[1].doc_id]


def test_pcm_blocks(table):
    text = "seek " * 2000
    rows = sorted(flac.pcm_blocks(flac.media_column(table([text, None]))).collect(), key=lambda r: (r.doc_id, r.first_sample))
    whole = b"".join(bytes(r.pcm) for r in rows if r.doc_id == 0)
    assert bytes(b ^ 128 for b in whole).rstrip(b"\0").decode() == text and [r.first_sample for r in rows] == [0, 4096, 8192, 0]
