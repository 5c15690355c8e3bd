"""Streams of every kind that the format knows, put together by hand, decode to what was put in; damage is found in each."""

import hashlib
import random

import numpy as np
import pytest

from ferrule.llm import flac


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> i & 1 for i in reversed(range(n))]
        return self

    def rice(self, r, k):
        u = r * 2 if r >= 0 else -r * 2 - 1
        self.bits += [0] * (u >> k) + [1]
        return self.put(u, k)

    def bytes(self):
        return np.packbits(self.bits).tobytes()


def crc(data, poly, n):
    x = 0
    for b in data:
        x ^= b << n - 8
        for _ in range(8):
            x = (x << 1 ^ (poly if x >> n - 1 & 1 else 0)) & (1 << n) - 1
    return x.to_bytes(n // 8, "big")


def frame(number, size, channels, bits_code, subframes, variable=0, size_code=7):
    head = Writer().put(0x7FFC, 15).put(variable, 1).put(size_code, 4).put(0, 4).put(channels, 4).put(bits_code, 3).put(0, 1).bytes()
    head += chr(number).encode() + (b"" if size_code not in (6, 7) else (size - 1).to_bytes(size_code - 5, "big"))
    head += crc(head, 7, 8)
    w = Writer()
    for s in subframes:
        s(w)
    body = head + w.bytes()
    return body + crc(body, 0x8005, 16)


def stream(frames, bits, channels, samples, md5=True, rate=44100):
    """samples: channels by samples."""
    x = np.array(samples)
    width = bits + 7 >> 3
    pcm = b"".join(int(v).to_bytes(width, "little", signed=True) for v in x.T.ravel())
    info = b"\x00\x10\xff\xff" + bytes(6) + (rate << 44 | channels - 1 << 41 | bits - 1 << 36 | x.shape[1]).to_bytes(8, "big")
    info += hashlib.md5(pcm).digest() if md5 else bytes(16)
    padding = b"\x81\x00\x00\x04" + bytes(4)
    return b"fLaC\x00\x00\x00\x22" + info + padding + b"".join(frames), pcm


def residual_of(x, coefs, shift=0):
    o = len(coefs)
    return [x[i] - (sum(c * x[i - 1 - j] for j, c in enumerate(coefs)) >> shift) for i in range(o, len(x))]


def fixed(x, order, bits, order_bits, k=2, method=0, plain=()):
    """A fixed predictor whose residuals lie in 2**order_bits partitions, those named in plain as plain numbers."""

    def write(w):
        w.put(0, 1).put(8 + order, 6).put(0, 1)
        for v in x[:order]:
            w.put(v, bits)
        w.put(method, 2).put(order_bits, 4)
        r, at = residual_of(x, flac.FIXED[order]), 0
        for part in range(1 << order_bits):
            n = len(x) // (1 << order_bits) - (order if part == 0 else 0)
            if part in plain:
                w.put((1 << 4 + method) - 1, 4 + method).put(bits + 4, 5)
                for v in r[at : at + n]:
                    w.put(v, bits + 4)
            else:
                w.put(k, 4 + method)
                for v in r[at : at + n]:
                    w.rice(v, k)
            at += n

    return write


def linear(x, coefs, shift, bits, k=3):
    def write(w):
        w.put(0, 1).put(32 + len(coefs) - 1, 6).put(0, 1)
        for v in x[: len(coefs)]:
            w.put(v, bits)
        w.put(9, 4).put(shift, 5)
        for c in coefs:
            w.put(c, 10)
        w.put(0, 2).put(0, 4).put(k, 4)
        for v in residual_of(x, coefs, shift):
            w.rice(v, k)

    return write


def constant(v, bits):
    return lambda w: w.put(0, 8).put(v, bits)


def verbatim(x, bits, wasted=0):
    def write(w):
        w.put(0, 1).put(1, 6).put(int(wasted > 0), 1)
        if wasted:
            w.put(1, wasted)
        for v in x:
            w.put(v >> wasted, bits - wasted)

    return write


RNG = random.Random(8)
WAVE = [round(60 * np.sin(i / 9)) + RNG.randrange(-2, 3) for i in range(64)]
LOUD = [v * 200 + RNG.randrange(-50, 50) for v in WAVE]
MID, SIDE = [(a + b) >> 1 for a, b in zip(LOUD, WAVE)], [a - b for a, b in zip(LOUD, WAVE)]
STREAMS = {
    "constant": stream([frame(0, 64, 0, 1, [constant(-5, 8)])], 8, 1, [[-5] * 64]),
    "plain": stream([frame(0, 64, 0, 1, [verbatim(WAVE, 8)])], 8, 1, [WAVE]),
    "wasted bits": stream([frame(0, 64, 0, 4, [verbatim([v * 8 for v in WAVE], 16, 3)])], 16, 1, [[v * 8 for v in WAVE]]),
    **{f"fixed {o} in partitions": stream([frame(0, 64, 0, 1, [fixed(WAVE, o, 8, 3)])], 8, 1, [WAVE]) for o in range(5)},
    "plain partitions": stream([frame(0, 64, 0, 1, [fixed(WAVE, 2, 8, 2, plain=(1, 3))])], 8, 1, [WAVE]),
    "wide parameters": stream([frame(0, 64, 0, 4, [fixed(LOUD, 1, 16, 1, k=9, method=1, plain=(0,))])], 16, 1, [LOUD]),
    "linear": stream([frame(0, 64, 0, 4, [linear(LOUD, (250, -120), 7, 16, 6)])], 16, 1, [LOUD]),
    "left and side": stream([frame(0, 64, 8, 4, [verbatim(LOUD, 16), verbatim(SIDE, 17)])], 16, 2, [LOUD, WAVE]),
    "side and right": stream([frame(0, 64, 9, 4, [verbatim(SIDE, 17), verbatim(WAVE, 16)])], 16, 2, [LOUD, WAVE]),
    "middle and side": stream([frame(0, 64, 10, 4, [verbatim(MID, 16), fixed(SIDE, 1, 17, 0, k=7)])], 16, 2, [LOUD, WAVE]),
    "two channels": stream([frame(0, 64, 1, 0, [verbatim(WAVE, 12), constant(7, 12)])], 12, 2, [WAVE, [7] * 64]),
    "blocks of any size": stream([frame(0, 64, 0, 1, [verbatim(WAVE, 8)], 1, 6), frame(64, 20, 0, 1, [verbatim(WAVE[:20], 8)], 1), frame(84, 3, 0, 1, [verbatim(WAVE[:3], 8)], 1)], 8, 1, [WAVE + WAVE[:20] + WAVE[:3]]),
    "numbered blocks": stream([frame(i, 64, 0, 1, [fixed(WAVE, 1, 8, 0)]) for i in range(130)], 8, 1, [WAVE * 130]),
    "no MD5": stream([frame(0, 64, 0, 1, [verbatim(WAVE, 8)])], 8, 1, [WAVE], md5=False),
}


@pytest.mark.parametrize("name", STREAMS)
def test_streams_by_hand(name):
    media, pcm = STREAMS[name]
    ((status, blocks),) = flac.blocks_of([media])
    assert status == "ok" and b"".join(b[3] for b in blocks) == pcm
    assert [b[0] for b in blocks] == [sum(x[1] for x in blocks[:i]) for i in range(len(blocks))] and all(media[b[2]] == 255 for b in blocks)
    info = flac.stream_info(media)[0]
    if (info.bits, info.channels) == (8, 1):
        assert flac.decode([media]) == [bytes(b ^ 128 for b in pcm)]
    rng = random.Random(name)
    for _ in range(25):
        hurt = bytearray(media)
        hurt[rng.randrange(blocks[0][2], len(media))] ^= 1 << rng.randrange(8)
        with pytest.raises(flac.Damaged):
            flac.read_stream(bytes(hurt))


def test_own_streams_need_no_seek_table():
    payload = flac.payload_of("words without end " * 700)[0]
    media = flac.encode([payload])[0]
    size = int.from_bytes(media[43:46], "big")
    bare = media[:4] + b"\x80" + media[5:42] + media[46 + size :]
    assert flac.decode([bare]) == [payload] and len(flac.read_stream(bare)[1]) == -(-len(payload) // flac.BLOCK)


def test_texts_longer_than_a_group(monkeypatch):
    payload = flac.payload_of("some text that is long " * 3000)[0]
    whole = flac.encode([payload])
    monkeypatch.setattr(flac, "CHUNK_BYTES", 10_000)
    assert flac.encode([payload]) == whole and flac.decode(whole) == [payload]


def test_status_of_rows(spark):
    rows = [(1, STREAMS["linear"][0]), (2, b"RIFF"), (3, None), (4, STREAMS["plain"][0][:-9])]
    found = flac.pcm_blocks(spark.createDataFrame(rows, "doc_id long, media binary")).collect()
    assert {r.doc_id: r.status == "ok" for r in found} == {1: True, 2: False, 3: False, 4: False}
    facts = {r.doc_id: r for r in flac.media_facts(spark.createDataFrame(rows[1:2] + [(5, STREAMS["plain"][0])], "doc_id long, media binary")).collect()}
    assert facts[2].payload_bytes == 0 and facts[2].status == "not a FLAC stream" and facts[5].payload_bytes == 64
