"""Joins whose broadcast side is measured, numbering without a window over a hot key, and names that don't clash."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions.durable import durable

#: Bytes, as JSON, up to which a side is broadcast.
BROADCAST_BYTES = 8 << 20


def unused(df: DataFrame, name: str) -> str:
    """name, with as many underscores behind it as no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def sized(df: DataFrame, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df marked for broadcast if its rows, as JSON, have most_bytes at most, which is measured; else df as it is, for a join by a shuffle."""
    held = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    return F.broadcast(df) if held <= most_bytes else df


def numbered(rows: DataFrame, key: str, order: str, number: str, total: str) -> DataFrame:
    """rows with their number from 1 within key by order, and how many the key has.

    A range sort deals even one key to many tasks; each numbers its part of a key, and what earlier tasks hold of it is added. order is unique within a key.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part, local, held, before, same = (unused(rows, c) for c in ("_part", "_local", "_held", "_before", "_same"))
    dealt = durable(rows.repartitionByRange(tasks, key, order).withColumn(part, F.spark_partition_id()))
    own = dealt.withColumn(local, F.row_number().over(Window.partitionBy(part, key).orderBy(order)))
    counts = dealt.groupBy(part, F.col(key).alias(same)).agg(F.count("*").alias(held)).withColumnRenamed(part, f"{part}of")
    earlier = Window.partitionBy(same).orderBy(f"{part}of").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn(before, F.coalesce(F.sum(held).over(earlier), F.lit(0))).withColumn(total, F.sum(held).over(Window.partitionBy(same)))
    met = own.join(counts, (F.col(part) == F.col(f"{part}of")) & F.col(key).eqNullSafe(F.col(same)))
    return met.select(*rows.columns, (F.col(before) + F.col(local)).alias(number), total)
