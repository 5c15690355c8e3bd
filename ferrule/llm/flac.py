"""FLAC media columns: documents as 8-bit mono streams, written, read back and verified in batches."""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import map_frames

#: Samples in a block, coefficients of a linear predictor, their bits and binary point, and the sample rate.
BLOCK, ORDER, PRECISION, SHIFT, RATE = 4096, 4, 12, 9, 8000
#: Coefficients of the format's fixed predictors by order.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
#: Payload bytes that are coded together.
CHUNK_BYTES = 1 << 20


class Damaged(ValueError):
    """A stream whose checksums or structure don't hold."""


@cache
def _crc_tables() -> tuple[list[int], np.ndarray]:
    """CRC-8 (polynomial 7) by byte; CRC-16 (polynomial 0x8005) by distance from the end and byte."""
    crc8 = list(range(256))
    crc16 = np.arange(256, dtype=np.int64) << 8
    for _ in range(8):
        crc8 = [(x << 1 ^ (7 if x & 128 else 0)) & 255 for x in crc8]
        crc16 = (crc16 << 1 ^ np.where(crc16 & 0x8000, 0x8005, 0)) & 0xFFFF
    far = np.empty((BLOCK + 64, 256), np.uint16)
    row = crc16
    for i in range(len(far)):
        far[i] = row
        row = (row << 8 & 0xFFFF) ^ crc16[row >> 8]
    return crc8, far


def _crc8(data: bytes) -> int:
    table, x = _crc_tables()[0], 0
    for b in data:
        x = table[x ^ b]
    return x


def _crc16(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC-16 of each of many byte runs in data: the remainder is a XOR of what each byte gives at its distance from the end."""
    far = _crc_tables()[1]
    to_end = np.repeat(starts + sizes - 1, sizes) - np.arange(len(data))
    return np.bitwise_xor.reduceat(far[to_end, data], starts)


def _utf8_number(n: int) -> bytes:
    return chr(n).encode("utf-8", "surrogatepass") if n < 0x110000 else bytes([0xF8 | n >> 24]) + bytes(0x80 | n >> s & 63 for s in (18, 12, 6, 0))


def _runs(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _groups(blocks):
    """Ranges of consecutive blocks of CHUNK_BYTES together, or a little more."""
    begin, size = 0, 0
    for i, b in enumerate(blocks):
        size += len(b)
        if size >= CHUNK_BYTES or i + 1 == len(blocks):
            yield begin, i + 1
            begin, size = i + 1, 0


def _encoded(blocks: list[bytes], number: list[int]) -> list[bytes]:
    """The frame of each block of at least 16 samples, with these frame numbers."""
    sizes = np.fromiter(map(len, blocks), np.int64, len(blocks))
    starts, frames = _runs(sizes), len(sizes)
    s = np.frombuffer(b"".join(blocks), np.uint8).astype(np.int32) - 128
    inside = np.arange(len(s), dtype=np.int32) - np.repeat(starts, sizes).astype(np.int32)
    total = lambda x: np.add.reduceat(x, starts, dtype=np.int64)

    back = [s]
    for j in range(1, ORDER + 1):
        x = np.zeros_like(s)
        x[j:] = s[:-j]
        x[inside < j] = 0
        back.append(x)
    lag = np.stack([total(s * x) for x in back], axis=1).astype(float)
    at = np.abs(np.arange(ORDER)[:, None] - np.arange(ORDER))
    matrix = lag[:, at] + (lag[:, :1] * 1e-9 + 1)[:, :, None] * np.eye(ORDER)
    weights = np.linalg.solve(matrix, lag[:, 1:, None])[:, :, 0]
    most = 1 << PRECISION - 1
    weights = np.clip(np.round(weights * (1 << SHIFT)), -most, most - 1).astype(np.int32)

    kinds = [(0, s), (1, s - back[1]), (2, s - 2 * back[1] + back[2])]
    guess = np.zeros_like(s)
    for j in range(ORDER):
        guess += np.repeat(weights[:, j], sizes) * back[j + 1]
    kinds.append((ORDER, s - (guess >> SHIFT)))
    cost = []
    for order, r in kinds:
        x = np.abs(r)
        x[inside < order] = 0
        cost.append(total(x))
    choice = np.argmin(np.stack(cost), axis=0)
    order = np.array([o for o, _ in kinds])[choice]
    each = np.repeat(choice, sizes)
    r = np.choose(each, [x for _, x in kinds])
    coded = inside >= np.repeat(order, sizes)
    u = np.where(coded, (r << 1) ^ (r >> 31), 0)
    n = sizes - order
    k0 = np.floor(np.log2(total(u) / np.maximum(n, 1) + 1)).astype(np.int64)
    tries = np.stack([np.clip(k0 + d, 0, 14) for d in (-1, 0, 1)])
    bits = np.stack([n * (k + 1) + total(u >> np.repeat(k, sizes).astype(np.int32)) for k in tries])
    pick = np.argmin(bits, axis=0)
    k, bits = tries[pick, np.arange(frames)], bits[pick, np.arange(frames)]
    plain = bits + order * 8 + 16 + 60 * (choice == 3) >= sizes * 8

    heads, head_bits = [], np.empty(frames, np.int64)
    for f in range(frames):
        full = sizes[f] == BLOCK
        head = bytes((0xFF, 0xF8, 0xC0 if full else 0x70, 0x02)) + _utf8_number(int(number[f])) + (b"" if full else int(sizes[f] - 1).to_bytes(2, "big"))
        head += bytes([_crc8(head)])
        o, begin = int(order[f]), int(starts[f])
        if plain[f]:
            heads.append(head + b"\x02")
            head_bits[f] = 8 * len(heads[-1])
            continue
        head += bytes([(32 + o - 1 if choice[f] == 3 else 8 + o) << 1]) + (s[begin : begin + o] & 255).astype(np.uint8).tobytes()
        value, length = 0, 0
        if choice[f] == 3:
            value, length = PRECISION - 1 << 5 | SHIFT, 9
            for w in weights[f].tolist():
                value, length = value << PRECISION | w & (1 << PRECISION) - 1, length + PRECISION
        value, length = value << 10 | int(k[f]), length + 10
        head_bits[f] = 8 * len(head) + length
        pad = -length % 8
        heads.append(head + (value << pad).to_bytes((length + pad) // 8, "big"))

    body_bits = np.where(plain, sizes * 8, bits)
    frame_bytes = -(-(head_bits + body_bits) // 8)
    where = _runs(frame_bytes)
    out = np.zeros(int(frame_bytes.sum()) * 8, np.uint8)
    for f in range(frames):
        x = np.unpackbits(np.frombuffer(heads[f], np.uint8))[: head_bits[f]]
        out[8 * where[f] : 8 * where[f] + len(x)] = x
    rice = coded & ~np.repeat(plain, sizes)
    kk, uu = np.repeat(k, sizes)[rice], u[rice].astype(np.int64)
    length = (uu >> kk) + 1 + kk
    count = np.where(plain, 0, n)
    first = np.repeat(np.cumsum(np.r_[0, length])[_runs(count)] if len(length) else np.zeros(frames, np.int64), count)
    end = np.cumsum(length) - first + np.repeat(8 * where + head_bits, count)
    out[end - kk - 1] = 1
    for b in range(int(kk.max()) if len(kk) else 0):
        has = kk > b
        out[end[has] - 1 - b] = uu[has] >> b & 1
    for f in np.flatnonzero(plain):
        begin = int(8 * where[f] + head_bits[f])
        out[begin : begin + 8 * sizes[f]] = np.unpackbits((s[starts[f] : starts[f] + sizes[f]] & 255).astype(np.uint8))
    data = np.packbits(out)
    crc = _crc16(data, where, frame_bytes)
    data = data.tobytes()

    return [data[w : w + n] + int(c).to_bytes(2, "big") for w, n, c in zip(where.tolist(), frame_bytes.tolist(), crc)]


def encode(payloads: list[bytes]) -> list[bytes]:
    """Each payload, of at least 16 bytes, as a FLAC stream with a seek table that names every frame.

    Blocks take the least of the fixed predictors of order 0 to 2 and a linear predictor fitted to the
    block, with one Rice parameter, or plain samples where those are not larger. Blocks are coded CHUNK_BYTES at a time.
    """
    blocks = [p[i : i + BLOCK] for p in payloads for i in range(0, len(p), BLOCK)]
    number = [i // BLOCK for p in payloads for i in range(0, len(p), BLOCK)]
    frames = [x for begin, end in _groups(blocks) for x in _encoded(blocks[begin:end], number[begin:end])]
    result, f = [], 0
    for p in payloads:
        points, at = [], 0
        parts = frames[f : f + -(-len(p) // BLOCK)]
        for n, body in enumerate(parts):
            points.append((n * BLOCK).to_bytes(8, "big") + at.to_bytes(8, "big") + len(blocks[f + n]).to_bytes(2, "big"))
            at += len(body)
        f += len(parts)
        lengths = [len(x) for x in parts]
        info = BLOCK.to_bytes(2, "big") * 2 + min(lengths).to_bytes(3, "big") + max(lengths).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big")
        signed = (np.frombuffer(p, np.uint8) ^ 128).tobytes()
        info += hashlib.md5(signed, usedforsecurity=False).digest()
        table = b"".join(points)
        if len(table) >= 1 << 24:  # a metadata block holds no more: readers then go from frame to frame
            result.append(b"".join((b"fLaC\x80\x00\x00\x22", info, *parts)))
        else:
            result.append(b"".join((b"fLaC\x00\x00\x00\x22", info, b"\x83", len(table).to_bytes(3, "big"), table, *parts)))
    return result


def seek_points(media: bytes) -> tuple[int, bytes, list[tuple[int, int, int, int]]]:
    """Samples in the stream, their MD5, and (first sample, offset in media, bytes, samples) of each frame by its seek table."""
    if media[:4] != b"fLaC":
        raise Damaged("not a FLAC stream")
    at, last, points, samples, md5 = 4, False, [], 0, b""
    while not last:
        last, kind, size = media[at] >= 128, media[at] & 127, int.from_bytes(media[at + 1 : at + 4], "big")
        block, at = media[at + 4 : at + 4 + size], at + 4 + size
        if kind == 0:
            packed = int.from_bytes(block[10:18], "big")
            samples, md5 = packed & (1 << 36) - 1, block[18:34]
            if packed >> 36 & 31 != 7 or packed >> 41 & 7:
                raise Damaged("only 8-bit mono streams are read")
        elif kind == 3:
            points = [tuple(int.from_bytes(block[i + a : i + b], "big") for a, b in ((0, 8), (8, 16), (16, 18))) for i in range(0, size, 18)]
    begins = [at + p[1] for p in points] + [len(media)]
    if not points or sum(p[2] for p in points) != samples or any(a >= b for a, b in zip(begins, begins[1:])):
        raise Damaged("the seek table doesn't cover the stream")
    return samples, md5, [(p[0], b, e - b, p[2]) for p, b, e in zip(points, begins, begins[1:])]


def _decoded(frames: list[bytes], samples: list[int]) -> list[np.ndarray]:
    """The samples, plus 128, of each of these frames as encode writes them; Damaged for any other."""
    sizes = np.array([len(x) for x in frames], np.int64)
    starts = _runs(sizes)
    raw = b"".join(frames) + bytes(4)
    data = np.frombuffer(raw, np.uint8)
    if _crc16(data[:-4], starts, sizes).any():
        raise Damaged("a frame's CRC-16 doesn't hold")

    count = len(frames)
    block, order, shift, k, begin, rice = (np.zeros(count, np.int64) for _ in range(6))
    coefs = np.zeros((32, count), np.int64)
    warm: list[bytes] = []
    for f, x in enumerate(frames):
        if x[0] != 0xFF or x[1] != 0xF8 or x[3] != 0x02 or x[2] not in (0xC0, 0x70):
            raise Damaged("a frame of another kind")
        tail = 4 + (1 if x[4] < 0x80 else 2 if x[4] < 0xE0 else 3 if x[4] < 0xF0 else 4 if x[4] < 0xF8 else 5)
        block[f] = BLOCK
        if x[2] == 0x70:
            block[f], tail = (x[tail] << 8 | x[tail + 1]) + 1, tail + 2
        if _crc8(x[:tail]) != x[tail]:
            raise Damaged("a frame header's CRC-8 doesn't hold")
        if block[f] != samples[f]:
            raise Damaged("a frame's size isn't that of its seek point")
        kind, bit = x[tail + 1] >> 1, 8 * (tail + 2)
        if kind == 1:
            begin[f] = bit // 8
            warm.append(b"")
            continue
        if not (8 <= kind <= 12 or kind >= 32):
            raise Damaged("an unknown subframe")
        o = order[f] = kind - 8 if kind <= 12 else kind - 31
        o = int(o)
        warm.append(x[bit // 8 : bit // 8 + o])
        bit += 8 * o
        span = int.from_bytes(x[bit // 8 : bit // 8 + 70], "big")
        left = 8 * len(x[bit // 8 : bit // 8 + 70])
        used = 0
        if kind >= 32:
            width, shift[f] = (span >> left - 4 & 15) + 1, span >> left - 9 & 31
            used = 9
            for j in range(o):
                used += width
                w = span >> left - used & (1 << width) - 1
                coefs[j, f] = w - (1 << width) if w >> width - 1 else w
        else:
            for j, w in enumerate(FIXED[o]):
                coefs[j, f] = w
        used += 10
        packed = span >> left - used & 1023
        if packed >> 4 or packed == 15:
            raise Damaged("an unknown residual coding")
        k[f], rice[f], begin[f] = packed, 1, bit + used

    by = np.argsort(-block, kind="stable")
    active = np.cumsum(np.bincount(block, minlength=BLOCK + 1)[::-1])[::-1]
    x = np.zeros((BLOCK, count), np.int32)
    residuals = np.zeros((BLOCK, count), np.int32)
    coded = [f for f in range(count) if rice[f]]
    if coded:
        _rice(data, starts, sizes, begin, order, k, block, np.array(coded), residuals)
    for f in range(count):
        if rice[f]:
            o = int(order[f])
            x[:o, f] = np.frombuffer(warm[f], np.int8)
        else:
            at = int(starts[f] + begin[f])
            x[: block[f], f] = data[at : at + block[f]].view(np.int8)
    deepest = int(order.max()) if count else 0
    x, residuals, c, sh = x[:, by], residuals[:, by], coefs[:, by].astype(np.int32), shift[by].astype(np.int32)
    fitted, oo = rice[by].astype(bool), order[by]
    even = bool((fitted & (oo == deepest)).all())
    for i in range(int(block.max()) if count else 0):
        m = int(active[i + 1])
        sum_ = np.zeros(m, np.int32)
        for j in range(min(deepest, i)):
            sum_ += c[j, :m] * x[i - 1 - j, :m]
        row = residuals[i, :m] + (sum_ >> sh[:m])
        if even:
            if i >= deepest:
                x[i, :m] = row
        else:
            take = fitted[:m] & (oo[:m] <= i)
            x[i, :m][take] = row[take]
    restored = np.empty_like(x)
    restored[:, by] = x
    columns = (np.ascontiguousarray(restored.T) + 128).astype(np.uint8)
    return [columns[f, : block[f]] for f in range(count)]


def decode(medias: list[bytes]) -> list[bytes]:
    """The payload of each 8-bit mono stream; Damaged if a checksum, the MD5 or the structure doesn't hold.

    Streams as encode writes them are read many frames at a time, CHUNK_BYTES together; any other goes through the reader of the whole format.
    """
    try:
        return _decode_own(medias)
    except Damaged:
        if len(medias) > 1:
            return [decode([m])[0] for m in medias]
    info, blocks = read_stream(medias[0])
    if (info.bits, info.channels) != (8, 1):
        raise Damaged("a payload is an 8-bit mono stream")
    return [(np.concatenate([x[0] for _, _, x in blocks]) + 128).astype(np.uint8).tobytes() if blocks else b""]


def _decode_own(medias: list[bytes]) -> list[bytes]:
    frames, samples, facts = [], [], []
    for m in medias:
        total, md5, points = seek_points(m)
        facts.append((len(points), md5))
        frames += [m[b : b + n] for _, b, n, _ in points]
        samples += [p[3] for p in points]
    columns = [x for begin, end in _groups(frames) for x in _decoded(frames[begin:end], samples[begin:end])]
    result, f = [], 0
    for count, md5 in facts:
        payload = np.concatenate(columns[f : f + count])
        f += count
        if hashlib.md5((payload ^ 128).tobytes(), usedforsecurity=False).digest() != md5:
            raise Damaged("the MD5 of the samples doesn't hold")
        result.append(payload.tobytes())
    return result


def _rice(data, starts, sizes, begin, order, k, block, coded, residuals) -> None:
    """Fill residuals of the frames in coded, whose bits 32-bit integers can count. A code is zeros, a one, and k bits, so the one that ends a code's zeros leads to the next
    code's; these links are followed in all frames at once."""
    bits = np.unpackbits(data)
    ones = np.flatnonzero(bits).astype(np.int32)
    before = np.cumsum(bits, dtype=np.int32)
    frame = np.repeat(np.arange(len(starts)), np.diff(np.r_[before[8 * starts - 1] * (starts > 0), len(ones)]))
    follow = before[np.minimum(ones + k[frame].astype(np.int32), len(bits) - 1)]
    follow = np.minimum(follow, len(ones) - 1)
    by = coded[np.argsort(-(block - order)[coded], kind="stable")]
    n = (block - order)[by]
    first = 8 * starts[by] + begin[by]
    j = before[first - 1]
    path = np.zeros((int(n[0]), len(by)), np.int32)
    active = np.cumsum(np.bincount(n, minlength=n[0] + 1)[::-1])[::-1]
    for i in range(int(n[0])):
        m = int(active[i + 1])
        j = j[:m]
        path[i, :m] = j
        j = follow[j]
    there = np.arange(int(n[0]))[:, None] < n
    end = ones[path].astype(np.int32)
    kk = k[by].astype(np.int32)
    zero = np.empty_like(end)
    zero[0] = end[0] - first
    zero[1:] = end[1:] - end[:-1] - 1 - kk
    at = end + 1
    byte = at >> 3
    word = (data[np.minimum(byte, len(data) - 3)].astype(np.int32) << 16) | (data[np.minimum(byte + 1, len(data) - 2)].astype(np.int32) << 8) | data[np.minimum(byte + 2, len(data) - 1)]
    low = (word >> np.maximum(24 - (at & 7) - kk, 0)) & ((1 << kk) - 1)
    if (np.where(there, at + kk, 0) > 8 * (starts + sizes)[by]).any() or (np.where(there, zero, 0) < 0).any():
        raise Damaged("codes run past their frame")
    u = (zero << kk) | low
    r = (u >> 1) ^ -(u & 1)
    for o in np.unique(order[by]):
        same = order[by] == o
        deep = int(n[same].max())
        residuals[o : o + deep, by[same]] = np.where(there[:deep, same], r[:deep, same], 0)


@dataclass(frozen=True)
class Info:
    """What STREAMINFO says: bits of a sample, channels, sample rate, samples in all (0: unknown), MD5 (zeros: unknown)."""

    bits: int
    channels: int
    rate: int
    samples: int
    md5: bytes


class Bits:
    """Reads a byte string bit by bit, the most significant first."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, 8 * at

    def take(self, n: int) -> int:
        end = self.at + n
        if end > 8 * len(self.data):
            raise Damaged("the stream ends within a frame")
        x = int.from_bytes(self.data[self.at >> 3 : end + 7 >> 3], "big") >> -end % 8
        self.at = end
        return x & (1 << n) - 1

    def signed(self, n: int) -> int:
        x = self.take(n)
        return x - (1 << n) if n and x >> n - 1 else x

    def zeros(self) -> int:
        """Zeros up to the next one, which is passed."""
        n = 0
        while not self.take(1):
            n += 1
        return n


def _number(bits: Bits) -> int:
    """A frame's or sample's number in the format's extended UTF-8."""
    first = bits.take(8)
    more = 0 if first < 0x80 else 8 - (first ^ 0xFF).bit_length() - 1
    if first >= 0x80 and not 1 <= more <= 6:
        raise Damaged("a frame's number is no number")
    n = first if more == 0 else first & (1 << 6 - more) - 1
    for _ in range(more):
        b = bits.take(8)
        if b >> 6 != 2:
            raise Damaged("a frame's number is no number")
        n = n << 6 | b & 63
    return n


def _residuals(bits: Bits, size: int, order: int) -> list[int]:
    """Rice-coded residuals in their partitions, with 4- or 5-bit parameters or plain numbers."""
    method = bits.take(2)
    if method > 1:
        raise Damaged("a reserved residual coding")
    width = 4 + method
    parts = 1 << bits.take(4)
    if size % parts or size // parts < order:
        raise Damaged("partitions don't fit the block")
    out = []
    for part in range(parts):
        n, k = size // parts - (order if part == 0 else 0), bits.take(width)
        if k == (1 << width) - 1:
            plain = bits.take(5)
            out += [bits.signed(plain) for _ in range(n)]
            continue
        for _ in range(n):
            u = bits.zeros() << k | bits.take(k)
            out.append(u >> 1 ^ -(u & 1))
    return out


def _subframe(bits: Bits, size: int, depth: int) -> np.ndarray:
    """A channel's samples: constant, plain, or a fixed or linear predictor with residuals; wasted low bits are put back."""
    if bits.take(1):
        raise Damaged("a subframe begins with a one")
    kind, wasted = bits.take(6), 0
    if bits.take(1):
        wasted = bits.zeros() + 1
        depth -= wasted
        if depth < 1:
            raise Damaged("more bits are wasted than there are")
    if kind == 0:
        x = [bits.signed(depth)] * size
    elif kind == 1:
        x = [bits.signed(depth) for _ in range(size)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind <= 12 else kind - 31
        if order > size:
            raise Damaged("a predictor is longer than its block")
        x = [bits.signed(depth) for _ in range(order)]
        coefs, shift = FIXED[order] if kind <= 12 else (), 0
        if kind >= 32:
            precision, shift = bits.take(4) + 1, bits.signed(5)
            if precision == 16 or shift < 0:
                raise Damaged("a reserved precision or a negative shift")
            coefs = [bits.signed(precision) for _ in range(order)]
        for r in _residuals(bits, size, order):
            x.append(r + (sum(c * x[-1 - j] for j, c in enumerate(coefs)) >> shift))
    else:
        raise Damaged("a reserved kind of subframe")
    return np.array(x, np.int64) << wasted


#: Block sizes, bits of a sample and numbers of channels by their codes in a frame header; 0 where the header or STREAMINFO says more.
BLOCK_SIZES = (0, 192, *(576 << i for i in range(4)), 0, 0, *(256 << i for i in range(8)))
SAMPLE_BITS = (0, 8, 12, None, 16, 20, 24, 32)


def read_frame(media: bytes, at: int, info: Info) -> tuple[int, int, np.ndarray, int]:
    """(first sample, or with fixed block size number of the frame; 1 if sample; channels by samples; end) of the frame at this byte."""
    bits = Bits(media, at)
    if bits.take(15) != 0x7FFC:
        raise Damaged("no frame where one should begin")
    variable, size_code, rate_code, channel_code, bits_code = bits.take(1), bits.take(4), bits.take(4), bits.take(4), bits.take(3)
    if bits.take(1) or size_code == 0 or rate_code == 15 or channel_code > 10 or SAMPLE_BITS[bits_code] is None:
        raise Damaged("a reserved value in a frame header")
    number = _number(bits)
    size = bits.take(8 * (size_code - 5)) + 1 if size_code in (6, 7) else BLOCK_SIZES[size_code]
    bits.take({12: 8, 13: 16, 14: 16}.get(rate_code, 0))
    if _crc8(media[at : bits.at >> 3]) != bits.take(8):
        raise Damaged("a frame header's CRC-8 doesn't hold")
    depth, count = SAMPLE_BITS[bits_code] or info.bits, channel_code + 1 if channel_code < 8 else 2
    side = {8: 1, 9: 0, 10: 1}.get(channel_code)
    x = np.stack([_subframe(bits, size, depth + (c == side)) for c in range(count)])
    if channel_code == 8:
        x[1] = x[0] - x[1]
    elif channel_code == 9:
        x[0] = x[0] + x[1]
    elif channel_code == 10:
        twice = 2 * x[0] + (x[1] & 1)
        x = np.stack([twice + x[1] >> 1, twice - x[1] >> 1])
    end = bits.at + 7 >> 3
    whole = Bits(media, end).take(16)
    crc = 0
    for b in media[at:end]:
        crc = (crc << 8 & 0xFFFF) ^ int(_crc_tables()[1][0, crc >> 8 ^ b])
    if crc != whole:
        raise Damaged("a frame's CRC-16 doesn't hold")
    return number, variable, x, end + 2


def stream_info(media: bytes) -> tuple[Info, int]:
    """What STREAMINFO says, and the byte at which frames begin."""
    if media[:4] != b"fLaC":
        raise Damaged("not a FLAC stream")
    at, last, info = 4, False, None
    while not last:
        if at + 4 > len(media):
            raise Damaged("the stream ends within its metadata")
        last, kind, size = media[at] >= 128, media[at] & 127, int.from_bytes(media[at + 1 : at + 4], "big")
        if kind == 0 and size >= 34:
            packed = int.from_bytes(media[at + 14 : at + 22], "big")
            info = Info((packed >> 36 & 31) + 1, (packed >> 41 & 7) + 1, packed >> 44, packed & (1 << 36) - 1, media[at + 22 : at + 38])
        at += 4 + size
    if info is None or at > len(media):
        raise Damaged("no STREAMINFO")
    return info, at


def packed_pcm(x: np.ndarray, bits: int) -> bytes:
    """Channels by samples as signed little-endian PCM, channels interleaved, each sample in whole bytes."""
    width = bits + 7 >> 3
    return x.T.astype("<i8").reshape(-1, 1).view(np.uint8)[:, :width].tobytes()


def read_stream(media: bytes) -> tuple[Info, list[tuple[int, int, np.ndarray]]]:
    """(info, [(first sample, byte at which its frame begins, channels by samples)]) of any FLAC stream, from frame to frame; no seek table is needed.

    Constant, plain, fixed and linear subframes, Rice codes in partitions with either width of parameter, wasted bits, both blocking
    strategies, 4 to 32 bits, one to eight channels with their decorrelation. Damaged if a checksum, the MD5 or the structure doesn't hold.
    """
    info, at = stream_info(media)
    blocks, first, digest = [], 0, hashlib.md5(usedforsecurity=False)
    while at < len(media):
        number, variable, x, end = read_frame(media, at, info)
        if variable and number != first or len(x) != info.channels:
            raise Damaged("a frame is out of place")
        blocks.append((first, at, x))
        digest.update(packed_pcm(x, info.bits))
        first, at = first + x.shape[1], end
    if info.samples and first != info.samples or any(info.md5) and digest.digest() != info.md5:
        raise Damaged("the samples aren't those of STREAMINFO")
    return info, blocks


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The text's UTF-8, filled with zeros up to a positive multiple of 64, and its length before that."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes(max(64, -(-len(data) // 64) * 64) - len(data)), len(data)


def _chunks(payloads):
    """Lists of consecutive payloads of CHUNK_BYTES together, or a little more."""
    chunk, size = [], 0
    for p in payloads:
        chunk.append(p)
        size += len(p)
        if size >= CHUNK_BYTES:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def media_column(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, media): each row's whole text as a FLAC stream.

    Null and empty texts are one block of 64 zero bytes. Only key and text are read. Repeated rows
    come back repeated, an empty table gives none. Memory is bounded by CHUNK_BYTES and the longest text.
    """

    def run(batches):
        import pandas as pd

        for batch in batches:
            at = 0
            for chunk in _chunks(payload_of(t)[0] for t in batch["text"]):
                some = batch.iloc[at : at + len(chunk)]
                at += len(chunk)
                yield pd.DataFrame({"doc_id": some["doc_id"], "n_bytes": [payload_of(t)[1] for t in some["text"]], "media": encode(chunk)})

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_frames(rows, run, "doc_id long, n_bytes long, media binary")


def blocks_of(medias: list[bytes]):
    """For each stream (status, [(first sample, samples, byte of the stream, PCM)]): ok, or what is wrong with a damaged one, which has no blocks."""
    try:
        decoded = _decode_own(medias)
    except Damaged:
        if len(medias) > 1:
            for m in medias:
                yield from blocks_of([m])
            return
        try:
            info, blocks = read_stream(medias[0])
        except Damaged as wrong:
            yield str(wrong), []
            return
        yield "ok", [(first, x.shape[1], at, packed_pcm(x, info.bits)) for first, at, x in blocks]
        return
    for m, payload in zip(medias, decoded):
        pcm = (np.frombuffer(payload, np.uint8) ^ 128).tobytes()
        yield "ok", [(first, size, at, pcm[first : first + size]) for first, at, _, size in seek_points(m)[2]]


def pcm_blocks(media: DataFrame) -> DataFrame:
    """(doc_id, first_sample, samples, media_offset, pcm, status): a row for each frame of each stream, its decoded samples as signed PCM,
    with the sample and the byte of the stream at which it starts, so that readers can seek.

    A stream's rows come together and in order. A damaged stream is one row without samples, whose status says what is wrong; a null one likewise.
    """
    return _blocks(media).drop("n_bytes", "media_bytes", "media_sha256")


def _blocks(media: DataFrame) -> DataFrame:
    """pcm_blocks, in whose rows that begin a stream n_bytes and the stream's length and SHA-256 stand too."""
    names = ["doc_id", "first_sample", "samples", "media_offset", "pcm", "status", "n_bytes", "media_bytes", "media_sha256"]

    def run(batches):
        import pandas as pd

        for batch in batches:
            at = 0
            for stored in _chunks(m or b"" for m in batch["media"]):
                rows = []
                some = batch.iloc[at : at + len(stored)]
                at += len(stored)
                for key, n_bytes, m, (status, blocks) in zip(some["doc_id"], some["n_bytes"], stored, blocks_of(stored)):
                    facts = (n_bytes, len(m), hashlib.sha256(m).hexdigest())
                    for first, size, offset, pcm in blocks or [(0, 0, 0, b"")]:
                        rows.append((key, first, size, offset, pcm, status, *(facts if first == 0 else (None, None, None))))
                yield pd.DataFrame(rows, columns=names, dtype=object)

    n_bytes = F.col("n_bytes") if "n_bytes" in media.columns else F.lit(None)
    return map_frames(
        media.select("doc_id", n_bytes.cast("long").alias("n_bytes"), "media"),
        run,
        "doc_id long, first_sample long, samples int, media_offset long, pcm binary, status string, n_bytes long, media_bytes long, media_sha256 string",
    )


class Facts:
    """What is known of a stream after some of its PCM blocks."""

    def __init__(self, *head):
        self.head, self.samples, self.frames, self.sha, self.tail = head, 0, 0, hashlib.sha256(), b""
        self.squares, self.peak, self.changes, self.last = 0, 0, 0, None

    def add(self, pcm: bytes) -> None:
        s = np.frombuffer(pcm, np.int8)
        if not len(s):
            return
        payload = (s.view(np.uint8) ^ 128).tobytes()
        self.sha.update(payload)
        self.tail = (self.tail + payload)[-64:]
        below = s < 0
        self.changes += int(np.count_nonzero(below[1:] != below[:-1])) + (self.last is not None and bool(below[0]) != self.last)
        wide = s.astype(np.int64)
        self.squares, self.peak = self.squares + int(wide @ wide), max(self.peak, int(np.abs(wide).max()))
        self.samples, self.frames, self.last = self.samples + len(s), self.frames + 1, bool(below[-1])

    def row(self) -> tuple:
        key, n_bytes, media_bytes, media_sha, status = self.head
        n = max(self.samples, 1)
        feature = (
            f"samples={self.samples};frames={self.frames};rms={np.sqrt(self.squares / n):.4f};peak={self.peak}"
            f";sign_changes={self.changes};bits={8 * media_bytes / n:.4f}"
        )
        return (key, n_bytes, self.samples, self.sha.hexdigest(), zlib.crc32(self.tail), media_bytes, media_sha, feature, status)


def media_facts(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, status, from the PCM blocks of the stored streams.

    Streams are read back and verified by pcm_blocks, whose rows are added up block by block, so a stream is never whole in memory here. status is ok, or
    what is wrong with a damaged stream, whose payload is empty. feature: samples, frames, root mean square, peak, sign changes and bits a sample.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "status"]

    def run(batches):
        import pandas as pd

        open_ = None
        for batch in batches:
            done = []
            for key, first, pcm, status, *facts in zip(*(batch[c] for c in ("doc_id", "first_sample", "pcm", "status", "n_bytes", "media_bytes", "media_sha256"))):
                if first == 0:
                    if open_:
                        done.append(open_.row())
                    open_ = Facts(key, *facts, status)
                open_.add(pcm)
            yield pd.DataFrame(done, columns=names, dtype=object)
        if open_:
            yield pd.DataFrame([open_.row()], columns=names, dtype=object)

    kinds = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, status string"
    return map_frames(_blocks(media), run, kinds)
