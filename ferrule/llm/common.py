"""What the corpus operators share: durable cuts of lineage, skew-proof joins, connected components."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A key is hot if it holds over one in HOT_SHARE rows, so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 1000
#: Rows that are dropped by a broadcast of their keys; more are dropped by a shuffle.
BROADCAST_ROWS = 1_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there.

    The folder is the one the cluster names in spark.checkpoint.dir. Only where that is unset, and all runs
    in one process, as in local tests, a temporary folder is set; a cluster without a named folder is refused.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not (context.master or "").startswith("local"):
            raise ValueError("name a shared folder in spark.checkpoint.dir")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)


def map_frames(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """df.mapInPandas(run, schema) whose integers stay integers beside nulls.

    pandas turns a long column with a null into floats, which hold integers only up to 2**53, so an id beside a
    null one would come back as another. Here run gets and may return nullable integers. schema: flat, "name type, ...".
    """
    fields = [f.split() for f in schema.split(",")]

    def batches(arrow):
        import pandas as pd
        import pyarrow as pa

        of = {
            "long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(),
            "double": pa.float64(), "boolean": pa.bool_(),
        }
        target = pa.schema([(name, of[kind]) for name, kind in fields])
        nullable = {pa.int64(): pd.Int64Dtype(), pa.int32(): pd.Int32Dtype()}
        for frame in run(batch.to_pandas(types_mapper=nullable.get) for batch in arrow):
            columns = [pa.array(frame[f.name], f.type, from_pandas=True) for f in target]
            yield pa.RecordBatch.from_arrays(columns, schema=target)

    return df.mapInArrow(batches, schema)


def drop_rows(rows: DataFrame, dropped: DataFrame, key: str) -> DataFrame:
    """rows whose key is not among the distinct ones of dropped; rows with a null key stay.

    Up to BROADCAST_ROWS keys are sent to the rows, so that these are not shuffled with their texts; more keys meet
    the rows in a shuffle.
    """
    dropped = cut(dropped)
    few = dropped.count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(dropped) if few else dropped, key, "left_anti")


def unused(df: DataFrame, name: str) -> str:
    """name, with as many underscores as it takes to differ from every column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def join_groups(rows: DataFrame, groups: DataFrame, key: str, copies: str, total: int | None = None) -> DataFrame:
    """Inner join of rows with groups, which has one row for each non-null key and, in the column copies,
    the number of rows that carry it. No task gets all rows of a hot key.

    Groups of over 1/HOT_SHARE of all rows are fewer than HOT_SHARE whatever the data, so they are
    broadcast and their rows stay where they are. The others are joined by a shuffle, in which no key
    has more than that share. total: all rows, where groups leaves some out, as rows of small groups are else taken for hot.
    """
    total = total if total is not None else groups.agg(F.sum(copies).alias("n")).first()["n"] or 0
    is_hot = F.col(copies) * HOT_SHARE > F.lit(total)
    hot = F.broadcast(groups.where(is_hot))
    cold = rows.join(F.broadcast(groups.where(is_hot).select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(cold.join(groups.where(~is_hot), key))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from each node that has an edge.

    edges: columns a and b, longs, undirected; loops and repeats do no harm. Large-star and
    small-star steps alternate (Kiveris et al., Connected Components in MapReduce and Beyond, 2014)
    until every node points at its smallest; rounds grow with the logarithm of the longest path.
    Every round is cut, so a lost executor never replays more than one. A hub's edges meet its minimum without
    meeting in one task: join_groups leaves those of a hot node where they are.
    """
    now = cut(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        seen = mark
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")))
        large = join_groups(both.where("b > a"), least, "a", "n").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(large.where("a <> b").distinct())
        least = cut(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")))
        small = join_groups(large, least, "a", "n").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())


def numbered(df: DataFrame, partitions: int, *order: str, rank: str = "rank", by: str) -> DataFrame:
    """df with a gapless number from 0 within each value of by, in the given order, which starts with by.

    A range sort spreads even a single value of by over many tasks; each task numbers its own rows,
    and what earlier tasks hold of the same value is added. by has no nulls.
    """
    kept = df.columns

    def number(batches):
        import numpy as np
        from pyspark import TaskContext

        at, value, count = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            v = batch[by].to_numpy()
            if not len(v):
                continue
            first = np.r_[True, v[1:] != v[:-1]]
            begin = np.maximum.accumulate(np.where(first, np.arange(len(v)), 0))
            local = np.arange(len(v)) - begin
            if value is not None and v[0] == value:
                local[begin == 0] += count
            value, count = v[-1], int(local[-1]) + 1
            yield batch.assign(_task=np.int32(at), _local=local.astype("int64"))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    local = cut(map_frames(df.repartitionByRange(partitions, *order).sortWithinPartitions(*order), number, f"{fields}, _task int, _local long"))
    held = local.groupBy("_task", by).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(by).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select("_task", by, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return local.join(offsets, ["_task", by]).select(*kept, (F.col("_local") + F.col("_before")).alias(rank))
