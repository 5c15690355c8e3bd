"""Exact duplicates by a tree-merge of sorted digest runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm.common import cut, drop_rows, join_groups, map_frames, unused

#: Most binomial rounds that one multiway merge joins, so at most 2**ROUND_BITS runs meet in it.
ROUND_BITS = 4
#: An entry of a run: what texts are compared by, the entry's best row, and the rows it stands for. Runs are sorted by all but the last.
DIGEST, BEST = ("sha", "bytes", "check"), ("doc_id", "row")
ENTRY = "sha binary, bytes long, check long, doc_id long, row long, copies long"


def merged(batches):
    """One entry for each digest of a run that is sorted by digest, then doc_id with nulls first, then row.

    Neighbours of one digest in all of its three parts give one entry: the last, that of the largest id, with the sum of their
    copies. The last digest of a batch waits for the next batch, so memory is that of a batch however many rows share a digest.
    """
    import numpy as np
    import pandas as pd

    open_ = None
    for batch in batches:
        if open_ is not None:
            batch = pd.concat([open_, batch], ignore_index=True)
        if not len(batch):
            continue
        sha = np.frombuffer(b"".join(batch["sha"]), np.uint64).reshape(-1, 4)
        rest = batch[["bytes", "check"]].to_numpy(np.int64)
        starts = np.r_[True, (sha[1:] != sha[:-1]).any(axis=1) | (rest[1:] != rest[:-1]).any(axis=1)].nonzero()[0]
        ends = np.r_[starts[1:], len(batch)] - 1
        runs = batch.iloc[ends].assign(copies=np.add.reduceat(batch["copies"].to_numpy(np.int64), starts))
        yield runs.iloc[:-1]
        open_ = runs.iloc[-1:]
    if open_ is not None:
        yield open_


def tree_merge(entries: DataFrame) -> DataFrame:
    """Entries of many partitions as one for each digest, in sorted runs that hold disjoint ranges of digests.

    Every partition first sorts its entries and merges them to a run. Then partitions exchange runs in binomial rounds by
    recursive halving: in round i, partitions whose numbers differ in bit i alone give each other the half of their runs that is
    the other's by bit i of the digest. Up to ROUND_BITS rounds are one exchange and one multiway merge: each partition receives
    its slice of the runs of 2**ROUND_BITS neighbours, each sorted, and keeps of every digest the verified largest id. So
    copies shrink at every level, every digest moves once a level, there are log(partitions) / ROUND_BITS levels, and no partition ends with more than its
    share of the digests, which are uniform.
    """
    order = [*DIGEST, *BEST]
    runs = map_frames(entries.sortWithinPartitions(*order), merged, ENTRY)
    bits = max(1, entries.rdd.getNumPartitions() - 1).bit_length()
    levels = -(-bits // ROUND_BITS)
    node, done = F.spark_partition_id(), 0
    prefix = F.conv(F.hex(F.substring("sha", 1, 4)), 16, 10).cast("long")
    for level in range(levels):
        step = (bits - done) // (levels - level)
        mask = ((1 << step) - 1) << done
        to = node.cast("long").bitwiseAND(F.lit(~mask)).bitwiseOR(prefix.bitwiseAND(F.lit(mask))).cast("int")
        runs = runs.repartitionById(1 << bits, to).sortWithinPartitions(*order)
        runs, done = map_frames(runs, merged, ENTRY), done + step
    return runs


def exact_groups(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty. The row with the largest key stays, a null
    key being the smallest; among repeated rows of that key exactly one is kept. Other columns of docs
    are not read, so their names can't clash. An empty table gives an empty result.

    Digests are merged by tree_merge. A digest is SHA-256, byte length and a 64-bit hash; entries are merged only where all
    three agree, and the row of an entry only names its group where they do too.
    """
    return _grouped(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


def _grouped(numbered: DataFrame) -> DataFrame:
    """exact_groups with row, which numbered brings beside doc_id and text."""
    whole = F.coalesce(F.col("text"), F.lit(""))
    digest = (F.unhex(F.sha2(whole, 256)).alias("sha"), F.octet_length(whole).cast("long").alias("bytes"), F.xxhash64(whole).alias("check"))
    rows = cut(numbered.select(*digest, "doc_id", "row", F.lit(1).cast("long").alias("copies")))
    found = tree_merge(rows).select(F.struct(*DIGEST).alias("digest"), F.struct(*BEST).alias("best"), F.col("copies").alias("group_size"))
    met = join_groups(rows.select("doc_id", F.struct(*DIGEST).alias("digest"), "row"), cut(found), "digest", "group_size")
    return met.select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest.sha")).alias("text_sha256"), "row",
    )


def drop_exact_copies(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs that exact_groups keeps, with all their columns whatever their names: one row of each text, also of repeated rows.

    docs is written once with a number for each row, and rows go by their numbers, so texts are not compared again.
    """
    row = unused(docs, "row_number")
    numbered = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    groups = _grouped(numbered.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(row).alias("row")))
    return drop_rows(numbered, groups.where(~F.col("kept")).select(F.col("row").alias(row)), row).select(*(numbered[c] for c in docs.columns))
