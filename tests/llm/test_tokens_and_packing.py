"""Tokenizers against the public libraries, packing against its own rules and the lower bound."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from ferrule.llm import byte_bpe, packing
from ferrule.llm.common import read_table
from ferrule.llm.queries import op6_packing, op9_byte_bpe

ODD = [
    "", None, " ", "  ", "a", "  lead", " \n x", "a  b", "a\n b", "a \nb", "a b \n", "x" * 3000, "ab" * 400, "don't we'll 's 't 're", "é ü x", "\x1c a", "日本語 テスト", "a\t b",
    "foo.\n\nBar  baz ", "İSTANBUL ΣΑΣ ς", "<|endoftext|> x", "3.14,15 v2.0!", "é!!", "word's, l'eau d'un", " x y", "\U0001f600\U0001f600", "a" * 9000 + " b",
]


@pytest.fixture(scope="module")
def library():
    path = public_tokenizers.path(byte_bpe.VOCABULARY)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.byte_bpe(path, public_tokenizers.PATTERN).ranks, special_tokens={})


@pytest.fixture(scope="module")
def words():
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    tokenizer.encode_special_tokens = True
    return tokenizer


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def check_bpe(rows, texts, library):
    for r in rows:
        text = texts[r.doc_id] or ""
        ids = library.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(packed(ids)).hexdigest()), text[:60]
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_bpe(spark, data, table, clash, library):
    rows = byte_bpe.token_digests(clash(table(ODD, repeat=[4]))).collect()
    assert len(rows) == len(ODD) + 1
    check_bpe(rows, ODD, library)
    check_bpe(op9_byte_bpe(spark, data).collect(), {r.doc_id: r.text for r in read_table(spark, data, "documents").collect()}, library)
    assert byte_bpe.token_digests(table([])).count() == 0


def test_bpe_of_random_words(library, monkeypatch):
    bpe = byte_bpe.ByteBpe(public_tokenizers.path(byte_bpe.VOCABULARY), public_tokenizers.PATTERN)
    rng = random.Random(3)
    texts = ["".join(rng.choice("abe th\n's é.,1 2\t€") for _ in range(rng.randrange(40))) for _ in range(2000)]
    assert bpe.encode(texts) == [packed(library.encode_ordinary(t)) for t in texts]
    monkeypatch.setattr(byte_bpe, "KEPT_WORDS", 10)  # what is kept is dropped all the time
    monkeypatch.setattr(byte_bpe, "WIDTHS", (2, 3))  # and longer words go through the heap
    assert [bpe.encode([t])[0] for t in texts[:200]] == [packed(library.encode_ordinary(t)) for t in texts[:200]]


def check_packing(rows, texts, words, capacity, copies):
    room, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        room[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for i, t in texts.items():
        ids = words.encode(t or "", add_special_tokens=False).ids + [1]
        want = [(n, at, len(ids[at : at + capacity]), zlib.crc32(packed(ids[at : at + capacity]))) for n, at in enumerate(range(0, len(ids), capacity))]
        assert sorted(pieces[i]) == sorted(want * copies.get(i, 1)), (t or "")[:60]
    for places in room.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(room), -(-sum(r.length for r in rows) // capacity)


@pytest.mark.parametrize("capacity", [7, 64, 4096])
def test_packing_of_odd_texts(table, clash, words, capacity):
    rows = packing.pack_documents(clash(table(ODD, repeat=[3, 3])), capacity=capacity).collect()
    check_packing(rows, dict(enumerate(ODD)), words, capacity, {3: 3})


def test_packing_of_the_table(spark, data, words):
    texts = {r.doc_id: r.text for r in read_table(spark, data, "documents").collect()}
    used, bound = check_packing(op6_packing(spark, data).collect(), texts, words, packing.CAPACITY, {})
    assert used <= bound + 1
    assert packing.pack_documents(read_table(spark, data, "documents").limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan(seed):
    rng = random.Random(seed)
    capacity = rng.choice((10, 100, 4096))
    counts = Counter(min(capacity, int(rng.lognormvariate(3, 1.5)) + 1) for _ in range(3000))
    counts[capacity // 2 + 1] += 500
    runs, used, taken = packing.plan(counts, capacity), Counter(), defaultdict(list)
    for length, rank, n, sequence, offset in runs:
        taken[length] += range(rank, rank + n)
        for s in range(sequence, sequence + n):
            assert used[s] == offset
            used[s] += length
    assert {n: sorted(v) for n, v in taken.items()} == {n: list(range(c)) for n, c in counts.items()}
    large = sum(c for n, c in counts.items() if 2 * n > capacity)
    assert max(used.values()) <= capacity and len(used) <= 1.03 * max(large, -(-sum(n * c for n, c in counts.items()) // capacity)) + 1


def test_words_that_are_forgotten(words, monkeypatch):
    monkeypatch.setattr(packing, "KEPT_WORDS", 3)
    tokenizer = packing.WordTokenizer(public_tokenizers.path(packing.VOCABULARY))
    for t in ["one two three, four", "one, one!! two", "five"] * 2:
        assert tokenizer([t])[0] == packed(words.encode(t, add_special_tokens=False).ids)
