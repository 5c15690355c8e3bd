"""Best-fit packing of tokenised documents into sequences, in bulk-synchronous rounds."""

from __future__ import annotations

import zlib
from collections import defaultdict
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import cut, map_frames, numbered

#: Tokens in a sequence, the id that ends a document, and the vocabulary.
CAPACITY, END, VOCABULARY = 4096, 1, "word_bpe_49k.json"
#: Words whose ids a worker keeps.
KEPT_WORDS = 800_000
#: Words that are encoded as one text, the last letter of these, and punctuation that is cut off their ends.
JOINED_WORDS, LAST_LATIN, TAIL = 256, "\u024f", "!#$%&()*+,./:;<=>?@[\\]^_`{|}~-"


class WordTokenizer:
    """Ids of whole texts by a vocabulary whose words never span white space: each distinct word is encoded once.

    A word is what stands between spaces and line ends. ASCII punctuation at its end, apostrophes apart, is a token
    run of its own after a letter or digit and is encoded apart, so that a word and its forms with commas
    share an entry.
    """

    def __init__(self, path: str):
        import numpy as np
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}

    def _encode(self, words: list[str]) -> list[bytes]:
        """Words of Latin letters alone are one run each, whose last id ends a word, so many are encoded as one text and cut there."""
        import numpy as np

        out: list[bytes] = [b""] * len(words)
        plain = [i for i, w in enumerate(words) if w.isalpha() and (w.isascii() or max(w) <= LAST_LATIN)]
        for at in range(0, len(plain), JOINED_WORDS):
            some = plain[at : at + JOINED_WORDS]
            ids = np.array(self.tokenizer.encode(" ".join([words[i] for i in some]), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(some):
                data, begin = ids.tobytes(), 0
                for i, end in zip(some, (4 * ends).tolist()):
                    out[i], begin = data[begin:end], end
                some = []
            for i in some:  # not one run each after all
                out[i] = self._alone([words[i]])[0]
        taken = set(plain)
        rest = [i for i in range(len(words)) if i not in taken]
        for i, ids in zip(rest, self._alone([words[i] for i in rest])):
            out[i] = ids
        return out

    def _alone(self, words: list[str]) -> list[bytes]:
        import numpy as np

        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def learn(self, words: set[str]) -> None:
        parts = []
        for w in words:
            if w and w[-1] in TAIL:
                stem = w.rstrip(TAIL)
                if stem and stem[-1].isalnum():
                    parts.append((w, stem, w[len(stem) :]))
        whole = words.difference([p[0] for p in parts]).union([p[1] for p in parts], [p[2] for p in parts])
        new = list(whole.difference(self.words))
        self.words.update(zip(new, self._encode(new)))
        known = self.words
        known.update([(w, known[stem] + known[tail]) for w, stem, tail in parts])

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = [t.replace("\n", " ").split(" ") for t in texts]
        unknown = set().union(*split).difference(self.words)
        if unknown:
            if len(self.words) + len(unknown) > KEPT_WORDS:
                self.words = {}
                unknown = set().union(*split)
            self.learn(unknown)
        known = self.words
        return [b"".join([known[w] for w in ws]) for ws in split]


@cache
def word_tokenizer(path: str) -> WordTokenizer:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return WordTokenizer(path)


def pieces(docs: DataFrame, vocabulary: str | None = None, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and the closing END, cut only where longer than capacity.

    Null texts count as empty and are the closing id alone. Whole texts are encoded, some at a time.
    """

    def run(batches):
        import pandas as pd
        import public_tokenizers

        encode = word_tokenizer(vocabulary or public_tokenizers.path(VOCABULARY))
        end = END.to_bytes(4, "little")
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            at, rows = 0, []
            while at < len(texts):
                upto, size = at, 0
                while upto < len(texts) and (size < 1 << 20 or upto == at):
                    size += len(texts[upto])
                    upto += 1
                for doc, ids in zip(batch["doc_id"].iloc[at:upto], encode(texts[at:upto])):
                    ids += end
                    for n, start in enumerate(range(0, len(ids) // 4, capacity)):
                        part = ids[4 * start : 4 * (start + capacity)]
                        rows.append((doc, n, start, len(part) // 4, zlib.crc32(part)))
                at = upto
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_frames(rows, run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, number, first sequence, offset): where runs of equally long pieces go.

    Pieces of one length are interchangeable, and so are sequences filled alike, so documents and gaps are
    held as runs: a length and a range of ranks, a gap and a range of sequences. Their number is bounded by
    capacity and rounds, whatever the corpus. A round sweeps both from the largest size to the smallest:
    a gap is pushed, and a run of pieces takes the smallest gaps pushed so far, those that fit best,
    rank by rank, one piece a gap. Then gaps are updated and the sweep repeats until nothing fits. What is left
    opens as many sequences as its tokens need at least, its longest pieces first, and rounds go on.
    """
    left = {n: [0, c] for n, c in counts.items() if c}  # length -> next rank, how many
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> runs of (first sequence, how many)
    found, sequences = [], 0
    while left:
        need = max(1, sum(n * c for n, (_, c) in left.items()) // capacity)
        for n in sorted(left, reverse=True):
            if not need:
                break
            rank, c = left[n]
            take = min(c, need)
            found.append((n, rank, take, sequences, 0))
            gaps[capacity - n].append((sequences, take))
            sequences, need = sequences + take, need - take
            left[n] = [rank + take, c - take]
        moved = True
        while moved:
            moved, stack, filled = False, [], []
            left = {n: v for n, v in left.items() if v[1]}
            open_gaps = sorted((g for g in gaps if g), reverse=True)
            at = 0
            for n in sorted(left, reverse=True):
                while at < len(open_gaps) and open_gaps[at] >= n:
                    stack += [(open_gaps[at], first, c) for first, c in gaps.pop(open_gaps[at])]
                    at += 1
                rank, c = left[n]
                while c and stack:
                    gap, first, many = stack.pop()
                    take = min(c, many)
                    found.append((n, rank, take, first, capacity - gap))
                    filled.append((gap - n, first, take))
                    if many > take:
                        stack.append((gap, first + take, many - take))
                    rank, c, moved = rank + take, c - take, True
                left[n] = [rank, c]
            for gap, first, many in [*stack, *filled]:
                gaps[gap].append((first, many))
        left = {n: v for n, v in left.items() if v[1]}
    return found


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut_pieces with sequence_id and offset: no sequence holds over capacity tokens and none has a gap before its end.

    Pieces are range-sorted by length; each gets its rank among those as long, which a hot length spreads over
    many tasks. Rounds of the plan run on the counts by length, at most capacity rows, and say which ranks
    go where; a task then looks up its own pieces.
    """
    rows = cut(cut_pieces)
    tasks = max(1, rows.rdd.getNumPartitions())
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = sorted(plan(counts, capacity))
    ranked = numbered(rows, tasks, "length", "doc_id", "piece", by="length")

    def place(batches):
        import numpy as np

        table = np.array(runs, np.int64).reshape(-1, 5)
        where = {int(n): i for i, n in enumerate(table[:, 0])}  # the last run of a length
        first = {int(n): i for i, n in reversed(list(enumerate(table[:, 0])))}
        for batch in batches:
            length, rank = (batch[c].to_numpy("int64") for c in ("length", "rank"))
            at = np.empty(len(batch), np.int64)
            for n in np.unique(length):
                of, low, high = length == n, first[int(n)], where[int(n)] + 1
                at[of] = low + np.searchsorted(table[low:high, 1], rank[of], side="right") - 1
            yield batch.drop(columns="rank").assign(sequence_id=table[at, 3] + rank - table[at, 1], offset=table[at, 4])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return map_frames(ranked, place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str | None = None, text: str = "text", key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of each row of docs: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    An empty or null text is one piece, the closing id. Repeated rows are packed as often as they come. An empty table gives no rows.
    """
    return pack(pieces(docs, vocabulary, text, key, capacity), capacity)
