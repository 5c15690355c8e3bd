"""Quality scores: random-indexing word vectors, pooled per document, under a two-layer network."""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import cut, map_frames, unused

#: Word buckets, shapes, dimensions of a vector, entries of an index vector, and the seed of all that is random.
WORD_BITS, SHAPES, DIM, ENTRIES, SEED = 14, 1024, 48, 4, 11
#: Blocks into which the table of vectors is dealt while it is summed, and partial tables that meet in one sum.
BLOCKS, FAN_IN = 16, 16
#: Most labelled rows to learn from: those with the least hash of their id.
MOST_LABELS = 20_000
#: Hidden units, passes, rows in a step, step size, weight decay, and the share of labelled rows that set the temperature.
HIDDEN, EPOCHS, STEP_ROWS, RATE, DECAY, CALIBRATION = 32, 30, 256, 3e-3, 1e-4, 5
#: Bytes of text that are taken together.
CHUNK_BYTES = 1 << 18
WORDS = 1 << WORD_BITS


@cache
def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """Class of a byte (0 white space, 1 letter or part of one, 2 digit, 3 other) and its lower case."""
    kind, low = np.full(256, 3, np.uint8), np.arange(256, dtype=np.uint8)
    kind[128:] = 1
    for a, z, k in (("A", "Z", 1), ("a", "z", 1), ("0", "9", 2)):
        kind[ord(a) : ord(z) + 1] = k
    kind[[0, 9, 10, 11, 12, 13, 32]] = 0
    low[65:91] += 32
    return kind, low


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64, and their inverses."""
    p, n = 0x9E3779B97F4A7C15, 1 << bits
    inverse = pow(p, -1, 1 << 64)
    up = lambda x: np.cumprod(np.r_[np.uint64(1), np.full(n - 1, x, np.uint64)])
    return up(p), up(inverse)


@cache
def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the entries of each word's and shape's sparse random vector."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, DIM, (WORDS + SHAPES, ENTRIES)), rng.choice([-1.0, 1.0], (WORDS + SHAPES, ENTRIES)).astype(np.float32)


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word bucket and shape of every token of these texts, and where each text's tokens start.

    A token is a run of bytes of one class. Its bucket is a hash of its lower case; its shape says class,
    length, case, whether it repeats one of the two before, and whether it stands right after another.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    kind_of, lower_of = _byte_tables()
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    begin = np.cumsum([0] + [len(r) + 1 for r in raw[:-1]]) if raw else np.zeros(0, np.int64)
    kind = kind_of[data]
    start = np.r_[0, np.flatnonzero(kind[1:] != kind[:-1]) + 1]
    end = np.r_[start[1:], len(data)]
    k = kind[start]
    start, end, k = start[k > 0], end[k > 0], k[k > 0].astype(np.int64)
    up, down = _powers(max(16, len(data).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(lower_of[data].astype(np.uint64) * up[: len(data)], out=sums[1:])
    h = (sums[end] - sums[start]) * down[start]
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    capitals = np.zeros(len(data) + 1, np.int32)
    np.cumsum((data >= 65) & (data <= 90), out=capitals[1:], dtype=np.int32)
    upper, length = capitals[end] - capitals[start], end - start
    case = np.where(upper == 0, 0, np.where(upper == length, 3, np.where(upper == 1, 1, 2)))
    again = np.zeros(len(h), np.int64)
    again[1:] |= h[1:] == h[:-1]
    again[2:] |= h[2:] == h[:-2]
    glued = np.zeros(len(h), np.int64)
    glued[1:] = start[1:] == end[:-1]
    shape = k << 8 | np.minimum(length, 15) << 4 | case << 2 | again << 1 | glued
    return (h >> np.uint64(64 - WORD_BITS)).astype(np.int64), shape, np.searchsorted(start, begin)


def _chunks(texts):
    chunk, size = [], 0
    for t in texts:
        chunk.append(t)
        size += len(t or "")
        if size >= CHUNK_BYTES:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def contexts(texts: list[str]) -> np.ndarray:
    """For each word bucket and shape the sum of the index vectors met around it: a word's neighbours and its shape, a shape's
    neighbours and itself."""
    place, sign = _index_vectors()
    total = np.zeros((WORDS + SHAPES) * DIM)
    for chunk in _chunks(texts):
        word, shape, first = tokens(chunk)
        if not len(word):
            continue
        same = np.ones(len(word), bool)  # as the text of the token before
        same[first[first < len(word)]] = False
        shape = shape + WORDS
        left = np.flatnonzero(same[1:])
        for of in (word, shape):
            for target, near in ((of[left], of[left + 1]), (of[left + 1], of[left]), (of, shape)):
                for e in range(ENTRIES):
                    total += np.bincount(target * DIM + place[near, e], sign[near, e], len(total))
    return total.reshape(-1, DIM)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit vectors of all word buckets and shapes, from the contexts of every word of every text.

    Each task sums over its texts a table of fixed size. Tables are dealt into BLOCKS and summed FAN_IN at a time,
    so no task holds more than FAN_IN blocks, and the driver gets one table.
    """

    def count(batches):
        import pandas as pd
        from pyspark import TaskContext

        table = sum((contexts(b["text"].tolist()) for b in batches), np.zeros((WORDS + SHAPES, DIM)))
        blocks = np.array_split(table.astype(np.float32), BLOCKS)
        yield pd.DataFrame({"block": range(BLOCKS), "node": TaskContext.get().partitionId(), "sums": [b.tobytes() for b in blocks]})

    def add(group):
        head = group.iloc[:1].copy()
        head["sums"] = [sum(np.frombuffer(s, np.float32) for s in group["sums"]).tobytes()]
        return head

    form = "block int, node int, sums binary"
    tables = cut(docs.select("text").mapInPandas(count, form))
    nodes = (tables.agg(F.max("node").alias("n")).first()["n"] or 0) + 1
    while nodes > 1:
        nodes = -(-nodes // FAN_IN)
        up = tables.withColumn("node", F.floor(F.col("node") / FAN_IN).cast("int"))
        tables = up.groupBy("block", "node").applyInPandas(add, form)
    found = {r["block"]: r["sums"] for r in tables.collect()}
    shape = np.array_split(np.zeros((WORDS + SHAPES, DIM), np.float32), BLOCKS)
    table = np.concatenate([np.frombuffer(bytes(found[b]), np.float32).reshape(-1, DIM) if b in found else shape[b] for b in range(BLOCKS)])
    return table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-6)


def pool(texts: list[str], vectors: np.ndarray) -> np.ndarray:
    """A row for each text: the mean vector of its words, then that of its shapes; zeros where it has none."""
    out = []
    for chunk in _chunks(texts):
        word, shape, first = tokens(chunk)
        n = np.diff(np.r_[first, len(word)])
        sums = np.zeros((len(chunk), 2 * DIM), np.float32)
        some = np.flatnonzero(n)
        if len(some):
            sums[some, :DIM] = np.add.reduceat(vectors[word], first[some], axis=0)
            sums[some, DIM:] = np.add.reduceat(vectors[shape + WORDS], first[some], axis=0)
        out.append(sums / np.maximum(n, 1).astype(np.float32)[:, None])
    return np.concatenate(out) if out else np.zeros((0, 2 * DIM), np.float32)


class Network:
    """One hidden layer of ReLU units and a logistic output, divided by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        """x: rows of features; y: 0 or 1. Every CALIBRATION-th row sets the temperature, the others the weights."""
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-4
        self.w1 = rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)).astype(np.float32)
        self.w2 = rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN).astype(np.float32)
        self.b1, self.b2 = np.zeros(HIDDEN, np.float32), np.float32(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        self.temperature = 1.0
        kept = np.arange(len(y)) % CALIBRATION == 0
        if len(set(y[~kept].tolist())) < 2:
            self.w2[:] = 0  # nothing to tell apart: the share of good rows is all there is
            return
        self._train(self._scaled(x[~kept]), y[~kept].astype(np.float32), rng)
        if len(set(y[kept].tolist())) == 2:
            z, t = self._logits(self._scaled(x[kept])), y[kept]
            loss = lambda s: np.logaddexp(0, np.where(t == 1, -z, z) / s).mean()
            self.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))

    def _scaled(self, x):
        return np.clip((x - self.mean) / self.scale, -8, 8).astype(np.float32)

    def _logits(self, x):
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def _train(self, x, y, rng):
        """Adam on the cross entropy."""
        names = ("w1", "b1", "w2", "b2")
        first, second, step = {n: 0.0 for n in names}, {n: 0.0 for n in names}, 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(x))
            for at in range(0, len(x), STEP_ROWS):
                a, t = x[order[at : at + STEP_ROWS]], y[order[at : at + STEP_ROWS]]
                hidden = np.maximum(a @ self.w1 + self.b1, 0)
                z = hidden @ self.w2 + self.b2
                d = (1 / (1 + np.exp(-z)) - t) / len(t)
                back = np.outer(d, self.w2) * (hidden > 0)
                slopes = {"w1": a.T @ back + DECAY * self.w1, "b1": back.sum(axis=0), "w2": hidden.T @ d + DECAY * self.w2, "b2": d.sum()}
                step += 1
                for n in names:
                    first[n] = 0.9 * first[n] + 0.1 * slopes[n]
                    second[n] = 0.999 * second[n] + 0.001 * slopes[n] ** 2
                    change = first[n] / (1 - 0.9**step) / (np.sqrt(second[n] / (1 - 0.999**step)) + 1e-8)
                    setattr(self, n, (getattr(self, n) - RATE * (1 - epoch / EPOCHS) * change).astype(np.float32))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Probabilities, rounded so that a text scores alike among whatever others."""
        z = np.clip(self._logits(self._scaled(x).astype(float)) / self.temperature, -30, 30)
        return np.round(1 / (1 + np.exp(-z)), 9)


def pooled(docs: DataFrame, table, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, row, vector): the pooled vectors of each row's whole text as 32-bit floats. table: broadcast word vectors."""

    def run(batches):
        for batch in batches:
            yield batch[["doc_id", "row"]].assign(vector=[v.tobytes() for v in pool(batch["text"].tolist(), table.value)])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    return cut(map_frames(rows, run, "doc_id long, row long, vector binary"))


def taught(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """(doc_id, y) of the rows to learn from: at most MOST_LABELS ids of docs whose crc32 as text leaves other than 1 modulo 3.

    Repeated and contrary labels of an id count once, as their mean, rounded. Labels without a value or a document don't count.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).cast("long").alias("doc_id")).agg(F.round(F.avg(label)).cast("int").alias("y"))
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    known = known.join(docs.select(F.col(key).cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    return cut(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELS))


def train(vectors: DataFrame, known: DataFrame) -> Network:
    """A network from the vectors of the rows in known. A repeated id teaches once, by the least of its vectors."""
    rows = vectors.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("y").alias("y"), F.min("vector").alias("vector")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    x = np.array([np.frombuffer(bytes(r["vector"]), np.float32) for r in rows], np.float32).reshape(-1, 2 * DIM)
    y = np.array([r["y"] for r in rows], np.int64)
    return Network(x, y) if len(y) else Network(np.zeros((2, 2 * DIM), np.float32), np.array([1, 1]))


def score_quality(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Scores depend on the text alone; higher means that label 1 is likelier. Null counts as empty, and empty texts
    score as a text without words. held_out is true where crc32 of the id as text leaves 1 modulo 3, so that it
    never taught; false without an id. Without labels all rows get one high score. Repeated rows come back repeated;
    an empty table gives none.
    """
    context = docs.sparkSession.sparkContext
    vectors = pooled(docs, context.broadcast(word_vectors(docs.select(F.col(text).alias("text")))), text, key)
    net = context.broadcast(train(vectors, taught(docs, labels, key)))

    def run(batches):
        for batch in batches:
            x = np.array([np.frombuffer(v, np.float32) for v in batch["vector"]], np.float32).reshape(-1, 2 * DIM)
            yield batch[["doc_id", "row"]].assign(score=net.value(x))

    scored = map_frames(vectors, run, "doc_id long, row long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs that score_quality predicts as 1, with all their columns whatever their names."""
    context = docs.sparkSession.sparkContext
    table = context.broadcast(word_vectors(docs.select(F.col(text).alias("text"))))
    known = taught(docs, labels, key)
    wanted = known.select(F.col("doc_id").alias(key))
    net = context.broadcast(train(pooled(docs.join(F.broadcast(wanted), key, "left_semi"), table, text, key), known))

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        return pd.Series(net.value(pool(texts.tolist(), table.value)), dtype="float64")

    return docs.withColumn(unused(docs, "score"), score(F.col(text))).where(F.col(unused(docs, "score")) >= 0.5).select(*docs.columns)
