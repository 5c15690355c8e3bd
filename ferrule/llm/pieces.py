"""SentencePiece encoding and decoding by tables of distinct chunks.

No piece of the model crosses from other characters into a whitespace marker, so a text falls into chunks, a run of markers and what
follows it, that are segmented apart. Each block of texts has a table of its distinct chunks, each is segmented once, and the ids are joined back by position.
"""

from __future__ import annotations

import codecs
import heapq
import itertools
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.byte_bpe import NEVER, PairTable

#: The model, and the marker that stands for a space.
MODEL, MARKER = "piece_bpe_32k.model", "▁"
#: Bytes of a block of texts, which has one table, and symbols that are merged at a time.
BLOCK_BYTES, SLAB = 8 << 20, 1 << 20
#: Characters of a chunk that is merged in rounds with others; longer ones are merged alone, by a heap.
LONGEST = 64


def _one_each(error: UnicodeDecodeError):
    """Every byte that is no part of a character becomes one replacement character."""
    return "�", error.start + 1


codecs.register_error("one_each", _one_each)


class PieceModel:
    """Ids of chunks, and the text of ids."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        self.byte = {int(model.id_to_piece(i)[1:-1], 16): i for i in every if model.is_byte(i)}
        self.control = {i for i in every if model.is_control(i)}
        special = self.control | set(self.byte.values()) | {i for i in every if model.is_unknown(i) or model.is_unused(i)}
        pieces = {model.id_to_piece(i): i for i in every if i not in special}
        if len(self.byte) != 256 or model.normalize(" Ａ  ﬁ ") != " Ａ  ﬁ ".replace(" ", MARKER).join((MARKER, "")):
            raise ValueError("the model must fall back to bytes, keep text as it is and put a marker before it")
        if any(MARKER in p.lstrip(MARKER) or (p.startswith(MARKER * 2) and p.strip(MARKER)) or any(c not in pieces for c in p) for p in pieces):
            raise ValueError("pieces must consist of pieces of one character and hold no marker after other characters")
        self.size = len(every)
        #: Symbols are ids; a character without a piece is its code point above all ids, and never merges.
        self.symbol = np.arange(0x110000, dtype=np.int32) + self.size
        for p, i in pieces.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        pairs = {(pieces[p[:k]], pieces[p[k:]]): i for p, i in pieces.items() for k in range(1, len(p)) if p[:k] in pieces and p[k:] in pieces}
        self.pairs, self.lookup = pairs, PairTable(pairs)
        #: Pieces by falling score; equal scores are equal, so that the leftmost of their pairs is merged first.
        scores = np.array([model.get_score(i) for i in every])
        self.order = np.full(self.size + 1, NEVER, np.int64)
        self.order[:-1] = np.unique(-scores, return_inverse=True)[1]
        self.text = [b"" if i in self.control else model.id_to_piece(i).replace(MARKER, " ").encode() for i in every]
        for b, i in self.byte.items():
            self.text[i] = bytes([b])
        self.text[model.unk_id()] = b" \xe2\x81\x87 "
        self.marked = {i for p, i in pieces.items() if p.startswith(MARKER)}

    def merged(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks that lie one after another, and how many each has.

        In each round every chunk that has a pair left merges the leftmost of its best; chunks without one leave.
        """
        done = np.zeros(len(symbols), np.int32)  # every chunk's ids at its old place
        count = sizes.copy()
        place = np.cumsum(sizes) - sizes  # of chunks within done
        left = np.arange(len(sizes))  # the chunks still at work
        last = np.zeros(len(symbols), bool)
        last[np.cumsum(sizes) - 1] = True
        pair = np.full(len(symbols), NEVER, np.int32)
        pair[:-1] = self.lookup(symbols[:-1], symbols[1:])
        pair[last] = NEVER
        while len(left):
            start = np.cumsum(count[left]) - count[left]
            best = np.minimum.reduceat(self.order[np.minimum(pair, self.size)] << 32 | np.arange(len(pair)), start)
            over = best >> 32 == NEVER
            if over.any():
                gone = np.repeat(over, count[left])
                to = np.repeat(place[left] - start, count[left]) + np.arange(len(pair))
                done[to[gone]] = symbols[gone]
                best, symbols, pair, left = best[~over] & 0xFFFFFFFF, symbols[~gone], pair[~gone], left[~over]
                best = best - np.cumsum(gone)[best]
            else:
                best = best & 0xFFFFFFFF
            if not len(left):
                break
            # the pair at best becomes one symbol, the one after it goes
            symbols[best], stay = pair[best], np.ones(len(pair), bool)
            stay[best + 1] = False
            ends = np.cumsum(count[left]) - 1
            count[left] -= 1
            tail = best + 1 == ends
            symbols, pair = symbols[stay], pair[stay]
            at = best - np.arange(len(best))
            pair[at[tail]] = NEVER
            inner = at[~tail]
            pair[inner] = self.lookup(symbols[inner], symbols[inner + 1])
            before = at[best > ends - count[left]]  # those that don't start their chunk
            pair[before - 1] = self.lookup(symbols[before - 1], symbols[before])
        return done[np.repeat(place, count) + _within(count)], count

    def merged_alone(self, symbols: list[int]) -> list[int]:
        """The same for one chunk of any length, in time n log n: pairs wait in a heap by order and place."""
        n, pairs, order = len(symbols), self.pairs, self.order
        ids, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        waiting: list = []

        def wait(i: int, j: int) -> None:
            if (whole := pairs.get((ids[i], ids[j]))) is not None:
                heapq.heappush(waiting, (int(order[whole]), i, ids[i], ids[j], whole))

        for i in range(n - 1):
            wait(i, i + 1)
        while waiting:
            _, i, a, b, whole = heapq.heappop(waiting)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = whole, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
                wait(i, after[i])
            if before[i] >= 0:
                wait(before[i], i)
        return [x for x in ids if x >= 0]

    def spelled(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids with the bytes of each character that has no piece in place of it."""
        odd = np.flatnonzero(ids >= self.size)
        if not len(odd):
            return ids, sizes
        spelt = [[self.byte[b] for b in chr(c).encode()] for c in (ids[odd] - self.size).tolist()]
        room = np.ones(len(ids), np.int64)
        room[odd] = [len(s) for s in spelt]
        out = np.repeat(ids, room)
        out[np.repeat(ids >= self.size, room)] = [b for s in spelt for b in s]
        ends = np.cumsum(room)[np.cumsum(sizes) - 1]
        return out, np.diff(ends, prepend=0)

    def segment(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of each chunk, markers and all, one after another, and how many each has."""
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        symbols = self.symbol[np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)]
        begin = np.cumsum(sizes) - sizes
        counts = np.zeros(len(chunks), np.int64)
        out: list = []
        short = np.flatnonzero(sizes <= LONGEST)
        ends = np.cumsum(sizes[short])
        cuts = np.searchsorted(ends, np.arange(SLAB, ends[-1] + SLAB, SLAB), "left") + 1 if len(short) else []
        at = 0
        for upto in cuts:
            some = short[at:upto]
            if len(some):
                ids, n = self.merged(symbols[np.repeat(begin[some], sizes[some]) + _within(sizes[some])], sizes[some])
                ids, counts[some] = self.spelled(ids, n)
                out.append((some, ids))
            at = upto
        for i in np.flatnonzero(sizes > LONGEST).tolist():
            ids = np.array(self.merged_alone(symbols[begin[i] : begin[i] + sizes[i]].tolist()), np.int32)
            ids, counts[i : i + 1] = self.spelled(ids, np.array([len(ids)]))
            out.append((np.array([i]), ids))
        place = np.cumsum(counts) - counts
        flat = np.zeros(int(counts.sum()), np.int32)
        for some, ids in out:
            flat[np.repeat(place[some], counts[some]) + _within(counts[some])] = ids
        return flat, counts

    def encode(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of an Arrow array of texts without nulls, one text's after another's, and how many each has."""
        import pyarrow.compute as pc

        split = pc.split_pattern(pc.replace_substring(texts, MARKER, " "), " ")
        coded = split.flatten().dictionary_encode()
        words, code = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
        parts = np.diff(split.offsets.to_numpy())
        parts[pc.binary_length(texts).to_numpy(zero_copy_only=False) == 0] = 0
        whole = np.repeat(np.arange(len(texts)), parts)
        if len(whole) != len(code):  # an empty text has an empty part, but no chunk
            code = code[np.repeat(parts > 0, np.diff(split.offsets.to_numpy()))]
        # A part is what follows a marker. Empty parts join the next one of their text, as markers before it.
        empty = pc.index(coded.dictionary, "").as_py()
        table = [MARKER + w for w in words]
        if empty >= 0 and len(code):
            bare = code == empty
            ends = np.r_[whole[1:] != whole[:-1], True]
            close = ~bare | ends
            chunk = np.flatnonzero(close)
            markers = np.diff(chunk, prepend=-1)  # parts up to and with the last
            more = np.flatnonzero(markers > 1)
            code, whole = code[chunk], whole[chunk]
            further: dict[tuple[int, int], int] = {}
            for i, key in zip(more.tolist(), zip(markers[more].tolist(), code[more].tolist())):
                if key not in further:
                    further[key] = len(table)
                    table.append(MARKER * key[0] + words[key[1]])
                code[i] = further[key]
            parts = np.bincount(whole, minlength=len(texts))
        ids, sizes = self.segment(table)
        room = sizes[code]
        begin = np.cumsum(sizes) - sizes
        return ids[np.repeat(begin[code], room) + _within(room)], np.bincount(whole, weights=room, minlength=len(texts)).astype(np.int64) if len(whole) else parts * 0

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the marker that starts the first piece goes, control ids give nothing, not even bytes on both sides that belong together."""
        if self.control.isdisjoint(ids):
            first, text = ids[0] if ids else None, b"".join([self.text[i] for i in ids]).decode("utf-8", "one_each")
        else:
            first = next((i for i in ids if i not in self.control), None)
            runs = [list(run) for control, run in itertools.groupby(ids, self.control.__contains__) if not control]
            text = "".join([b"".join([self.text[i] for i in run]).decode("utf-8", "one_each") for run in runs])
        return text[1:] if first in self.marked else text


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of the runs of these sizes."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


@cache
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def _path(model: str | None) -> str:
    import public_tokenizers

    return model or public_tokenizers.path(MODEL)


def encode_pieces(docs: DataFrame, model: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, ids array<int>): the ids of each whole text, without begin or end.

    Null texts count as empty and have no ids. Repeated rows come back repeated, an empty table gives none. Only the columns named are
    read. A block of some BLOCK_BYTES of texts, or one longer text, has a table of its own; nothing is kept between blocks.
    """

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        pieces = piece_model(_path(model))
        for batch in batches:
            texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
            ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            at = 0
            while at < len(texts):
                upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BLOCK_BYTES)))
                ids, sizes = pieces.encode(texts.slice(at, upto - at))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, upto - at), lists], names=["doc_id", "ids"])
                at = upto

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode_pieces(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded) of (doc_id, ids): the text of the ids. Null ids count as none."""

    def run(batches):
        import pyarrow as pa

        pieces = piece_model(_path(model))
        for batch in batches:
            for at in range(0, len(batch), 256):
                some = batch.slice(at, 256)
                decoded = [pieces.decode([] if ids is None else ids.tolist()) for ids in some.column("ids").to_numpy(zero_copy_only=False)]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def piece_digests(docs: DataFrame, model: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 of the decimal ids joined by commas, decoded_sha256, for each row of docs."""
    whole = decode_pieces(encode_pieces(docs, model, text, key), model)
    return whole.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
