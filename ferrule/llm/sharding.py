"""Shards under a byte limit by extendible hashing."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrule.llm.common import cut, join_groups, numbered, unused

#: Bits of the hash a directory can use: 15 hexadecimal digits of MD5.
HASH_BITS = 60
#: Bits by which one round deepens the directory.
ROUND_BITS = 12


def extendible_shards(docs: DataFrame, limit_bytes: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of docs: key, n_bytes, depth, prefix, part, shard_bytes, oversized.

    A shard is the set of rows whose hash starts with the depth bits of prefix. The directory starts as
    one bucket; only a bucket of over limit_bytes is split on its next bit, so depth is the smallest
    number of bits at which the row's bucket fits. The hash is of the key alone, unique as a rule, so
    neither a hot source nor copies of a text make a bucket that can't be split. part is 0, except
    where rows of one repeated key outgrow the limit by themselves, with all bits used up: then they are
    dealt to numbered parts. A row larger than the limit is a shard of its own, marked oversized.
    Null texts have 0 bytes; a null key hashes as the empty text. An empty table gives no shards.

    Each round sums bytes for all prefixes that are ROUND_BITS longer, from these for all depths
    between; rounds go on for buckets that still are too large. All is DataFrame operations.
    """
    hashed = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")
    rows = cut(
        docs.select(
            F.col(key).alias("doc_id"),
            F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"),
            hashed.alias("h"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    total = rows.agg(F.sum("n_bytes").alias("n")).first()["n"] or 0
    found, open_rows, low = [], rows, 0
    step = max(ROUND_BITS, math.ceil(math.log2(max(1, total / limit_bytes))) + 3)
    while low < HASH_BITS:
        high, top = min(HASH_BITS, low + step), low + (low > 0)
        leaf = lambda bits: F.shiftrightunsigned("h", HASH_BITS - bits)
        leaves = cut(open_rows.groupBy(leaf(high).alias("leaf")).agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("rows")))
        level = F.explode(F.sequence(F.lit(top), F.lit(high)))
        tree = leaves.select("n_bytes", level.alias("depth"), "leaf").withColumn("prefix", F.expr(f"shiftrightunsigned(leaf, {high} - depth)"))
        sums = tree.groupBy("depth", "prefix").agg(F.sum("n_bytes").alias("shard_bytes"))
        fits = sums.where(F.col("shard_bytes") <= limit_bytes)
        halves = sums.where((F.col("shard_bytes") > limit_bytes) & (F.col("depth") < high))
        halves = halves.select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
        shards = fits.where(F.col("depth") == top).unionByName(fits.join(halves, ["depth", "prefix"]))
        span = F.expr(f"sequence(shiftleft(prefix, {high} - depth), shiftleft(prefix + 1, {high} - depth) - 1)")
        covered = shards.select(F.explode(span).alias("leaf"), F.struct("depth", "prefix", "shard_bytes").alias("shard"))
        first = cut(leaves.select("leaf", "rows").join(covered, "leaf", "left"))
        placed = join_groups(open_rows.withColumn("leaf", leaf(high)), first, "leaf", "rows")
        found.append(placed.where("shard is not null").select("doc_id", "n_bytes", "shard.*", F.lit(0).alias("part")))
        if not first.where("shard is null").limit(1).count():
            break
        open_rows = cut(placed.where("shard is null").select("doc_id", "n_bytes", "h", "row"))
        low, step = high, ROUND_BITS
    else:
        found.append(_repeated_keys(open_rows, limit_bytes))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    columns = ["doc_id", "n_bytes", F.col("depth").cast("int").alias("depth"), "prefix", F.col("part").cast("int").alias("part"), "shard_bytes"]
    return out.select(*columns, (F.col("shard_bytes") > limit_bytes).alias("oversized"))


def _repeated_keys(rows: DataFrame, limit_bytes: int) -> DataFrame:
    """Rows of buckets that no bit splits: those of one repeated key. First the rows that don't fit alone, each
    its own part, then the others, dealt by running bytes, at least half a limit to a part.

    The running sum is over blocks of rows, then within a block, so no task holds all rows of a key.
    """
    block = F.floor(F.col("row") / 4096)
    blocks = rows.groupBy("h", block.alias("block")).agg(F.sum("n_bytes").alias("block_bytes"))
    before = Window.partitionBy("h").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("block_bytes").over(before), F.lit(0)))
    inside = Window.partitionBy("h", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    run = rows.withColumn("block", block).join(blocks, ["h", "block"])
    run = run.withColumn("begin", F.col("before") + F.coalesce(F.sum("n_bytes").over(inside), F.lit(0)))
    half = max(1, limit_bytes // 2)
    small = F.col("n_bytes") <= limit_bytes - half
    run = run.withColumn("part", F.when(small, F.floor(F.col("begin") / half) * 2).otherwise(F.col("row") * 2 + 1))
    sums = run.groupBy("h", "part").agg(F.sum("n_bytes").alias("shard_bytes"))
    number = F.dense_rank().over(Window.partitionBy("h").orderBy("part"))
    sums = sums.select("h", "part", "shard_bytes", (number - 1).alias("number"))
    placed = run.select("doc_id", "n_bytes", "h", "part").join(sums, ["h", "part"])
    return placed.select(
        "doc_id", "n_bytes", F.lit(HASH_BITS).alias("depth"), F.col("h").alias("prefix"), "shard_bytes", F.col("number").cast("int").alias("part")
    )


def write_shards(docs: DataFrame, shards: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> None:
    """Write docs below path, a folder for each shard, from what extendible_shards says of them: every row to one shard.

    Most keys have one shard, in which all their rows go. A key dealt to several parts is large, so there are few; its rows
    of equal bytes are interchangeable, so these are numbered on both sides and the equal numbers meet. A null key equals itself.
    Folders are named by shard, or shard_ where docs has a column of that name.
    """
    # columns of docs keep their names: those added here take others, and so does the folders' where docs has a column shard
    k, folder, last, own, n = (unused(docs, c) for c in ("_key", "shard", "_last", "_row", "_n"))
    name = F.concat_ws("-", "depth", "prefix", "part")
    known = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    alike = lambda size: F.concat_ws("/", k, size.cast("string")).alias("_alike")
    placed = shards.select(known("doc_id").alias(k), F.col("n_bytes").alias("_bytes"), name.alias(folder))
    keys = cut(placed.groupBy(k).agg(F.min(folder).alias(folder), F.max(folder).alias(last)))
    rows = docs.withColumn(k, known(key))
    one = rows.join(keys.where(F.col(folder) == F.col(last)).select(k, folder), k).drop(k)
    split = F.broadcast(keys.where(F.col(folder) < F.col(last)).select(k))
    dealt = cut(rows.join(split, k).withColumn(own, F.monotonically_increasing_id()))
    n_bytes = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = numbered(dealt.select(alike(n_bytes), own), parts, "_alike", own, rank=n, by="_alike")
    right = numbered(placed.join(split, k).select(alike(F.col("_bytes")), folder), parts, "_alike", folder, rank=n, by="_alike")
    several = dealt.join(left.join(right, ["_alike", n]).select(own, folder), own).drop(k, own)
    one.unionByName(several).repartition(folder).write.partitionBy(folder).parquet(path)
