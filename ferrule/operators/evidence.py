"""Evidence of a dossier: duplicates, selection with a contradicting item, and what a request asked to see."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most items of a family and of a dossier, and most sources of an item.
PER_FAMILY, PER_DOSSIER, PER_ITEM = 3, 15, 3


def first_of_each(evidence: DataFrame) -> DataFrame:
    """The first item, by ordinal, of each family, signal, time and first source URL without its final slashes."""
    url = F.regexp_replace(F.coalesce("source_url", F.lit("")), "/+$", "")
    once = Window.partitionBy("request_id", "family", "signal", "ts", url).orderBy("ordinal")
    return evidence.withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n")


def _select(items: DataFrame, keys: list[str], most: int, tie: list[Column], rank: str) -> DataFrame:
    """The most largest contributions of each key. Where both directions exist but the selection shows one, its last item
    gives way to the largest of the other direction."""
    order = [F.abs("contribution").desc(), F.col("ts").desc(), *tie]
    group = Window.partitionBy(*keys)
    directed = F.when(F.col("direction") != "neutral", F.col("direction"))
    ranked = items.withColumn(rank, F.row_number().over(group.orderBy(*order)))
    top = F.when(F.col(rank) <= most, directed)
    facts = ranked.withColumns({
        "_all": F.min(directed).over(group) != F.max(directed).over(group),
        "_top": F.min(top).over(group),
        "_one": F.min(top).over(group) == F.max(top).over(group),
    })
    swap = F.coalesce(F.col("_all") & F.col("_one"), F.lit(False))
    other = F.min(F.when((F.col("direction") != "neutral") & (F.col("direction") != F.col("_top")), F.col(rank))).over(group)
    facts = facts.withColumn("_swap", swap).withColumn("_other", other)
    taken = F.when(F.col("_swap"), (F.col(rank) < most) | (F.col(rank) == F.col("_other"))).otherwise(F.col(rank) <= most)
    return facts.where(taken).drop("_all", "_top", "_one", "_swap", "_other")


def compact_families(items: DataFrame, most: int = PER_FAMILY) -> DataFrame:
    """At most so many items of each family of each request, family_rank among all; both directions stay visible."""
    return _select(items, ["request_id", "family"], most, [F.col("ordinal")], "family_rank")


def compact_dossier(items: DataFrame, most: int = PER_DOSSIER) -> DataFrame:
    """At most so many of these items of each request, dossier_rank among all; both directions stay visible."""
    return _select(items, ["request_id"], most, [F.col("family_rank"), F.col("ordinal")], "dossier_rank")


def shown(items: DataFrame, include_sources: Column, include_raw: Column) -> DataFrame:
    """items with at most PER_ITEM sources, or none, and the raw signal only where a request wants it."""
    none = F.slice("sources", 1, 0)
    sources = F.when(include_sources, F.slice("sources", 1, PER_ITEM)).otherwise(none)
    return items.withColumn("sources", sources).withColumn("raw_signal", F.when(include_raw, F.col("raw_signal")))
