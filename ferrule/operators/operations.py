"""Replay, readiness, retention and the site's funnel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions.keys import hash_key
from ferrule.functions.numbers import wilson_lower

#: Conversions from which a funnel's rate is read.
READY_FROM = 250


def eligible(records: DataFrame, evaluation_at: Column) -> DataFrame:
    """Records that were both accepted and available at the time of evaluation: accepted_at, available_at."""
    return records.where(F.greatest("accepted_at", "available_at") <= evaluation_at)


def observation_ids(records: DataFrame, *parts: str) -> DataFrame:
    """records with observation_key and observation_id, chained hashes of their parts."""
    key = F.concat(F.lit("cek_"), hash_key(*parts))
    return records.withColumn("observation_key", key).withColumn("observation_id", F.concat(F.lit("ceo_"), hash_key("observation_key")))


def order_free_digest(records: DataFrame, by: list[str], line: Column, ident: str) -> DataFrame:
    """(by, lines, digest): the hash of a group's lines, sorted by identifier, whatever order they came in.

    Each line is reduced to its hash before groups are formed, so a group moves 32 bytes a line; a group's lines are sorted by Spark and read one after another, never held together.
    """
    each = records.select(*by, F.col(ident).alias("_ident"), F.sha2(line, 256).alias("_hash"))

    def run(batches):
        import hashlib

        import pyarrow as pa

        now, digest, lines, kinds, between = None, hashlib.sha256(), 0, None, b""
        row = lambda: pa.RecordBatch.from_arrays([*(pa.array([v], t) for v, t in zip(now, kinds)), pa.array([lines], pa.int64()), pa.array([digest.hexdigest()])], names=[*by, "lines", "digest"])
        for batch in batches:
            kinds = [batch.schema.field(c).type for c in by]
            for key, value in zip(zip(*(batch.column(c).to_pylist() for c in by)), batch.column("_hash").to_pylist()):
                if key != now:
                    if now is not None:
                        yield row()
                    now, digest, lines, between = key, hashlib.sha256(), 0, b""
                if value is not None:  # a null line has no hash, but counts
                    digest.update(between + value.encode())
                    between = b"\n"
                lines += 1
        if now is not None:
            yield row()

    kinds = ", ".join(f"`{c}` {each.schema[c].dataType.simpleString()}" for c in by)
    return each.repartition(*by).sortWithinPartitions(*by, "_ident", "_hash").mapInArrow(run, f"{kinds}, lines long, digest string")


def gates_passed(checks: DataFrame, required: DataFrame) -> DataFrame:
    """(gate, passed, missing): a gate passes if every required check of it is there and passed."""
    found = required.join(checks, ["gate", "check"], "left").groupBy("gate")
    good = F.coalesce(F.col("state") == "passed", F.lit(False))
    return found.agg(F.min(good).alias("passed"), F.count_if(F.col("state").isNull()).alias("missing"))


def once_per_visitor(events: DataFrame, excluded: Column) -> DataFrame:
    """The first event of each kind of each visitor who isn't excluded: visitor, kind, ts, ordinal."""
    first = Window.partitionBy("visitor", "kind").orderBy("ts", "ordinal")
    return events.where(~excluded).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def one_per_minute(requests: DataFrame) -> DataFrame:
    """The first request of each address in each minute: address, ts, ordinal."""
    minute = Window.partitionBy("address", F.date_trunc("minute", "ts")).orderBy("ts", "ordinal")
    return requests.withColumn("_n", F.row_number().over(minute)).where("_n = 1").drop("_n")


def funnel(visits: DataFrame, by: list[str]) -> DataFrame:
    """(by, views, conversions, rate, lower, ready): visits has one row per visitor with viewed and converted."""
    found = visits.groupBy(*by).agg(F.count_if("viewed").alias("views"), F.count_if(F.col("viewed") & F.col("converted")).alias("conversions"))
    rate = F.when(F.col("views") > 0, F.col("conversions") / F.col("views")).otherwise(0.0)
    return found.withColumns({"rate": rate, "lower": wilson_lower(F.col("conversions"), F.col("views")), "ready": F.col("views") >= READY_FROM})


def unexpired(rows: DataFrame, as_of: Column, days: dict[str, int], kind: str = "kind", ts: str = "ts") -> DataFrame:
    """Rows younger than the days their kind is kept; kinds without a limit stay."""
    limit = F.lit(None).cast("int")
    for name, n in days.items():
        limit = F.when(F.col(kind) == name, n).otherwise(limit)
    return rows.where(limit.isNull() | (F.col(ts) > as_of - F.make_dt_interval(F.coalesce(limit, F.lit(0)))))


def latest_buckets(buckets: DataFrame, keep: int, key: str = "issuer", day: str = "day") -> DataFrame:
    """The newest daily buckets of each key, as many as are kept."""
    newest = Window.partitionBy(key).orderBy(F.col(day).desc())
    return buckets.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= keep).drop("_n")


def binary_quality(predicted: Column, actual: Column) -> list[Column]:
    """Counts, precision and recall of a rule against labels, as aggregates. An extension."""
    tp, fp, fn = (F.count_if(a & b) for a, b in ((predicted, actual), (predicted, ~actual), (~predicted, actual)))
    return [tp.alias("hits"), fp.alias("false_alarms"), fn.alias("misses"), F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall")]
