"""Byte-level BPE encoding and decoding in numpy matrices of many words at a time."""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import map_frames

#: The ranks, the widths of matrices, and words a worker keeps. Longer words are merged one by one.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
WIDTHS = (4, 8, 12, 16, 24, 32, 64, 128, 256)
KEPT_WORDS = 250_000
#: Words in a matrix.
ROWS = 1 << 15
#: The rank of a pair that no merge joins.
NEVER = np.int32(1 << 30)
#: White space that isn't a single character between others.
RUNS_OF_SPACE = re.compile(r"\s\s|\A\s|\s\Z").search


class PairTable:
    """Ranks of pairs of ids in a hash table with linear probing: at a quarter full, few steps reach any pair."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        bits = max(4, (4 * len(pairs)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NEVER, np.int32)
        key = np.array([a << 32 | b for a, b in pairs], np.int64)
        value = np.array(list(pairs.values()), np.int32)
        at = self._start(key)
        self.steps = 0
        while len(key):
            free = self.keys[at] == -1
            first = np.zeros(len(key), bool)
            first[np.unique(at, return_index=True)[1]] = True
            take = free & first
            self.keys[at[take]], self.values[at[take]] = key[take], value[take]
            key, value, at = key[~take], value[~take], at[~take] + 1 & self.mask
            self.steps += 1

    def _start(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; NEVER where there is none or an id is negative."""
        key = (left.astype(np.int64) << 32 | right).ravel()
        at = self._start(key)
        met = self.keys[at]
        found = np.where(met == key, self.values[at], NEVER)
        open_ = np.flatnonzero((met != key) & (met != -1))
        while len(open_):
            at[open_] = at[open_] + 1 & self.mask
            met = self.keys[at[open_]]
            hit = met == key[open_]
            found[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (met != -1)]
        found[key < 0] = NEVER
        return found.reshape(left.shape)


class ByteBpe:
    """Ids of texts as the ranks define them, and the bytes of ids."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.find = regex.compile(pattern).findall
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        ids = self.ranks
        pairs = {(ids[t[:i]], ids[t[i:]]): r for t, r in ids.items() for i in range(1, len(t)) if t[:i] in ids and t[i:] in ids}
        self.pairs, self.lookup = pairs, PairTable(pairs)
        self.bytes_of = [b""] * (max(ids.values()) + 1)
        for t, r in ids.items():
            self.bytes_of[r] = t
        self.heads: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def merge_matrix(self, words: list[bytes], width: int) -> list[np.ndarray]:
        """Ids of words of at most width bytes: in each round every row merges its leftmost pair of least rank and closes up."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        x = np.full((len(words), width), -1, np.int32)
        inside = np.arange(width) < sizes[:, None]
        x[inside] = self.single[np.frombuffer(b"".join(words), np.uint8)]
        done: list = [None] * len(words)
        rows = np.arange(len(words))
        rank = self.lookup(x[:, :-1], np.where(inside[:, 1:], x[:, 1:], -1))
        rank[~inside[:, 1:]] = NEVER
        while len(rows):
            at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(rows), np.int64)
            line = np.arange(len(rows))
            least = rank[line, at] if rank.shape[1] else np.full(len(rows), NEVER)
            over = least == NEVER
            if over.any():
                for i, ids, n in zip(rows[over].tolist(), x[over], sizes[over].tolist()):
                    done[i] = ids[:n]
                x, rank, at, least, rows, sizes = x[~over], rank[~over], at[~over], least[~over], rows[~over], sizes[~over]
                line = np.arange(len(rows))
            if not len(rows):
                break
            x[line, at] = least
            stay = np.ones(x.shape, bool)
            stay[line, at + 1] = False
            x = x[stay].reshape(len(rows), -1)
            stay = np.ones(rank.shape, bool)
            stay[line, at] = False
            rank = rank[stay].reshape(len(rows), -1)
            sizes = sizes - 1
            before, after = np.flatnonzero(at > 0), np.flatnonzero(at + 1 < sizes)
            rank[before, at[before] - 1] = self.lookup(x[before, at[before] - 1], x[before, at[before]])
            rank[after, at[after]] = self.lookup(x[after, at[after]], x[after, at[after] + 1])
            tail = np.flatnonzero((at + 1 >= sizes) & (at < rank.shape[1]))
            rank[tail, at[tail]] = NEVER
        return done

    def merge_long(self, word: bytes) -> np.ndarray:
        """The same for one word of any length, in time n log n: pairs wait in a heap by rank and place."""
        ids = self.single[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before, pairs = list(range(1, n + 1)), list(range(-1, n - 1)), self.pairs
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := pairs.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (q := pairs.get((r, ids[k]))) is not None:
                    heapq.heappush(heap, (q, i, r, ids[k]))
            if (h := before[i]) >= 0 and (q := pairs.get((ids[h], r))) is not None:
                heapq.heappush(heap, (q, h, ids[h], r))
        return np.array([t for t in ids if t >= 0], np.int32)

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        bucket = np.searchsorted(WIDTHS, size)
        for b, width in enumerate(WIDTHS):
            at = np.flatnonzero(bucket == b)
            rows = max(1, min(ROWS, (1 << 20) // width))
            for start in range(0, len(at), rows):
                some = at[start : start + rows].tolist()
                for i, ids in zip(some, self.merge_matrix([words[i] for i in some], width)):
                    out[i] = ids.tobytes()
        for i in np.flatnonzero(bucket == len(WIDTHS)).tolist():
            out[i] = self.merge_long(words[i]).tobytes()
        return out

    @staticmethod
    def joined(parts: list[str]) -> list[str]:
        """What stood between spaces, with those spaces again, in parts between which the pattern never matches: before a space that has
        other than white space on both sides."""
        bad = [not p or p[0].isspace() or p[-1].isspace() for p in parts]
        out = [parts[0]]
        for i in range(1, len(parts)):
            if bad[i] or bad[i - 1]:
                out[-1] += " " + parts[i]
            else:
                out.append(" " + parts[i])
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers. Distinct words are encoded once while they are kept:
        those after a single space by what follows it, the first word of a text and stretches of more white space as they are."""
        heads: list[list[str]] = []
        words: list[list[str]] = []
        for t in texts:
            parts = t.split(" ")
            if RUNS_OF_SPACE(t):
                heads.append(self.joined(parts))
                words.append([])
            else:
                heads.append(parts[:1])
                words.append(parts[1:])
        new_heads, new_words = set().union(*heads).difference(self.heads), set().union(*words).difference(self.words)
        if len(self.words) + len(self.heads) + len(new_words) + len(new_heads) > KEPT_WORDS:
            self.heads, self.words = {}, {}
            new_heads, new_words = set().union(*heads), set().union(*words)
        if new_heads or new_words:
            order = [*new_heads, *new_words]
            found = [self.find(p) for p in new_heads] + [self.find(" " + p) for p in new_words]
            distinct = list(set().union(*found))
            ids = dict(zip(distinct, self.encode_words([w.encode() for w in distinct])))
            packed = [ids[ws[0]] if len(ws) == 1 else b"".join([ids[w] for w in ws]) for ws in found]
            self.heads.update(zip(order[: len(new_heads)], packed))
            self.words.update(zip(order[len(new_heads) :], packed[len(new_heads) :]))
        first, then = self.heads, self.words
        return [b"".join([first[p] for p in h] + [then[p] for p in w]) for h, w in zip(heads, words)]

    def decode(self, ids: bytes) -> bytes:
        of = self.bytes_of
        return b"".join([of[i] for i in np.frombuffer(ids, "<u4").tolist()])


@cache
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def encode_documents(docs: DataFrame, vocabulary: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, ids): the ids of each whole text as little-endian unsigned 32-bit integers.

    Null texts count as empty and have no ids. Repeated rows come back repeated, an empty table gives none.
    """

    def run(batches):
        import pandas as pd
        import public_tokenizers

        bpe = byte_bpe(vocabulary or public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
        for batch in batches:
            texts, at = [t or "" for t in batch["text"]], 0
            while at < len(texts):
                upto, size = at, 0
                while upto < len(texts) and (size < 1 << 20 or upto == at):
                    size += len(texts[upto])
                    upto += 1
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[at:upto], "ids": bpe.encode(texts[at:upto])})
                at = upto

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_frames(rows, run, "doc_id long, ids binary")


def decode_documents(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """encoded with the column decoded: the bytes of its ids."""

    def run(batches):
        import public_tokenizers

        bpe = byte_bpe(vocabulary or public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
        for batch in batches:
            for at in range(0, len(batch), 256):
                some = batch.iloc[at : at + 256]
                yield some.assign(decoded=[bpe.decode(x) for x in some["ids"]])

    return map_frames(encoded, run, "doc_id long, ids binary, decoded binary")


def token_digests(docs: DataFrame, vocabulary: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of docs, from its ids and what they decode to."""
    whole = decode_documents(encode_documents(docs, vocabulary, text, key), vocabulary)
    return whole.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
