"""SimHash near-duplicates through an inverted index on byte positions."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import components, cut, drop_rows, join_groups, map_frames

#: Words in a shingle, seed of XXH64, and the bits by which linked fingerprints may differ.
WORDS, SEED, MOST_BITS = 3, 42, 2
#: A link breaks at most MOST_BITS of the 8 bytes, so this many positional bytes are shared.
LEAST_BYTES = 8 - MOST_BITS
#: A posting of more fingerprints than this is split on one more position.
LONG_POSTING = 64


def fingerprint(text: str | None) -> int:
    """SimHash of the 3-word shingles as a signed 64-bit integer.

    A-Z are lower-cased and words end at ASCII white space. Repeats count. Fewer than three words
    make one shingle; no words, or null, make zero. A bit is set if it is in over half the hashes.
    """
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    shingles = zip(*(words[i:] for i in range(WORDS))) if len(words) >= WORDS else [words]
    n = max(1, len(words) - WORDS + 1)
    ones = np.zeros(64, np.int64)
    shingles = map(b" ".join, shingles)
    digest = xxhash.xxh64_intdigest
    for start in range(0, n, 16384):
        size = min(16384, n - start)
        h = np.fromiter((digest(s, SEED) for _, s in zip(range(size), shingles)), np.uint64, size)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, fp) for each row of docs; fp is the signed 64-bit fingerprint of the whole text."""

    def run(batches):
        for batch in batches:
            yield batch[["doc_id"]].assign(fp=[fingerprint(t) for t in batch["text"]])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return map_frames(rows, run, "doc_id long, fp long")


#: The bits of a fingerprint that each set of byte positions covers; a set has a bit for each position.
COVERED = tuple(int.from_bytes(bytes(255 * (at >> i & 1) for i in range(8)), "little", signed=True) for at in range(256))


def met(entries: DataFrame) -> DataFrame:
    """entries, columns node, fp and shared, a set of positions, that agree in these positions' bytes with another fingerprint,
    with their posting and its length."""
    bits = F.get(F.array(*(F.lit(x).cast("long") for x in COVERED)), F.col("shared"))
    entries = cut(entries.withColumn("posting", F.struct("shared", F.col("fp").bitwiseAND(bits).alias("bytes"))))
    lengths = cut(entries.groupBy("posting").agg(F.count("*").alias("length")).where("length > 1"))
    return cut(join_groups(entries, lengths, "posting", "length", entries.count()))


def one_more(entries: DataFrame) -> DataFrame:
    """An entry for each position that is not yet in shared, with it."""
    wider = F.filter(F.array(*(F.col("shared").bitwiseOR(F.lit(1 << i)) for i in range(8))), lambda m: m != F.col("shared"))
    return entries.select("node", "fp", F.explode(wider).alias("shared"))


def links(fps: DataFrame) -> DataFrame:
    """(a, b): all pairs of fingerprints that differ in MOST_BITS or fewer bits. fps: fp, distinct, with a node id.

    The inverted index is on byte positions. A linked pair shares LEAST_BYTES of 8 positional bytes at least. Single bytes
    have 256 values, so their postings would grow with the corpus; the index has two levels. The first posts four
    positions at a time: the positions form four couples, of which a link breaks two at most, so the pair meets in one of
    the six sets of two couples. The second posts, within each of these postings, every other position by itself, and there pairs
    are formed; a linked pair meets at two of them or more. Every meeting adds the positions it shares to the pair's tally. Pairs
    of fewer than LEAST_BYTES go, and what is left is verified on all bits.

    A posting of the second level with more than LONG_POSTING fingerprints is split on yet another position before pairs are
    formed: its linked pairs share one. Then only fingerprints meet that agree in six bytes, of which there are at most 65,536
    whatever the corpus, and a few hundred where they are near copies of one text.
    """
    couples = F.array(*(F.lit(3 << 2 * i | 3 << 2 * j) for i, j in combinations(range(4), 2)))
    first = met(fps.select("node", "fp", F.explode(couples).alias("shared")))
    second = met(one_more(first))
    long = met(one_more(second.where(F.col("length") > LONG_POSTING)).distinct())
    meetings = second.where(F.col("length") <= LONG_POSTING).unionByName(long)
    left, right = (meetings.select("posting", F.col("node").alias(n), F.col("fp").alias(f)) for n, f in (("a", "x"), ("b", "y")))
    pairs = left.join(right, "posting").where("a < b")
    tally = pairs.groupBy("a", "b").agg(F.bit_or("posting.shared").alias("shared"), F.first("x").alias("x"), F.first("y").alias("y"))
    tally = tally.where(F.bit_count("shared") >= LEAST_BYTES)
    return tally.where(F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= MOST_BITS).select("a", "b")


def near_groups(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hexadecimal digits), component_id, fp.

    component_id is the smallest doc_id reachable over links of fingerprints that differ in at most
    MOST_BITS bits; equal fingerprints are linked, those of empty and null texts, zero, too. Rows without a
    doc_id link others like any row; they name no component and have null where no row of theirs has an id. A doc_id
    on rows of several texts doesn't link them. Other columns of docs are not read. Repeated rows come back
    repeated; an empty table gives an empty result.
    """
    rows = cut(fingerprints(docs, text, key))
    nodes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")).withColumn("node", F.col("fp")))
    linked = components(links(nodes.select("node", "fp")))
    named = cut(nodes.join(linked, "node", "left").select("fp", "copies", "least", F.coalesce("component", "node").alias("component")))
    least = cut(named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("fps")))
    named = join_groups(named.select("fp", "copies", "component"), least, "component", "fps").select("fp", "copies", "component_id")
    found = join_groups(rows, cut(named), "fp", "copies")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp")


def drop_near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs whose key names their group: one document, that of the smallest key, of each.

    Rows without a key stay, as nothing says which of them are one document, and so do repeated rows of the key that stays.
    """
    groups = near_groups(docs, text, key)
    gone = groups.groupBy("doc_id").agg(F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays")).where("doc_id is not null and not stays")
    return drop_rows(docs, gone.select(F.col("doc_id").alias(key)), key).select(*(docs[c] for c in docs.columns))
