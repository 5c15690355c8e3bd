"""The fixed, explainable score of evidence, for all requests at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions.numbers import clamp, recency

#: Points of a family, of any other family, and the families that a request expects.
FAMILY_WEIGHTS = {"filings_news": 16.0, "insider_trading": 12.0, "options_flow": 10.0, "technical": 6.0, "social": 4.0, "alternative": 4.0}
OTHER_WEIGHT = 3.0
EXPECTED = ("filings_news", "insider_trading", "options_flow", "technical", "social")
HIGH_VALUE = ("filings_news", "insider_trading")
#: Coverage lost for each missing family, high-value and other, and the least coverage.
LOST_HIGH, LOST_OTHER, LEAST_COVERAGE = 0.15, 0.05, 0.60


def weight_of(family: Column) -> Column:
    found = F.lit(OTHER_WEIGHT)
    for name, weight in FAMILY_WEIGHTS.items():
        found = F.when(family == name, weight).otherwise(found)
    return found


def within_lookback(evidence: DataFrame, as_of: Column, days: Column | int) -> tuple[DataFrame, DataFrame]:
    """Evidence inside the window, its edge included, and what is older."""
    old = F.col("ts") < as_of - F.make_dt_interval(F.lit(days) if isinstance(days, int) else days)
    return evidence.where(~old), evidence.where(old)


def contributions(evidence: DataFrame, as_of: Column, days: Column | int) -> DataFrame:
    """evidence with raw, family_points and contribution.

    evidence: request_id, family, direction, strength, confidence, quality, ts. The raw value is polarity times strength, confidence,
    quality and recency. A family's points are its raw sum, clamped to 1 either way, times its weight, dealt to its items in
    proportion; items that cancel out keep their weight unscaled, so that they still cancel.
    """
    days = F.lit(days) if isinstance(days, int) else days
    polarity = F.when(F.col("direction") == "bullish", 1.0).when(F.col("direction") == "bearish", -1.0).otherwise(0.0)
    raw = polarity * F.col("strength") * F.col("confidence") * F.col("quality") * recency(F.col("ts"), as_of, days)
    family = Window.partitionBy("request_id", "family")
    scored = evidence.withColumn("raw", raw).withColumn("_sum", F.sum("raw").over(family))
    weight = weight_of(F.col("family"))
    points = clamp(F.col("_sum"), -1, 1) * weight
    scale = F.when(F.col("_sum") == 0, weight).otherwise(points / F.when(F.col("_sum") != 0, F.col("_sum")))
    return scored.withColumn("family_points", points).withColumn("contribution", F.col("raw") * scale).drop("_sum")


def coverage(missing_high: Column, missing_other: Column) -> Column:
    return F.greatest(F.lit(LEAST_COVERAGE), 1 - LOST_HIGH * missing_high - LOST_OTHER * missing_other)


def scores(evidence: DataFrame, as_of: Column, days: Column | int, expected: tuple[str, ...] = EXPECTED) -> DataFrame:
    """(request_id, score, direction, confidence, coverage, families, items) of each request that has evidence.

    The raw sums are taken per family in one aggregation and folded per request in a second, which
    shuffles a row for each family of a request. Points of families beyond the expected count; coverage looks at
    these only.
    """
    days = F.lit(days) if isinstance(days, int) else days
    polarity = F.when(F.col("direction") == "bullish", 1.0).when(F.col("direction") == "bearish", -1.0).otherwise(0.0)
    trust = F.col("strength") * F.col("confidence") * F.col("quality")
    families = evidence.groupBy("request_id", "family").agg(
        F.sum(polarity * trust * recency(F.col("ts"), as_of, days)).alias("raw"),
        F.sum("strength").alias("strength"),
        F.sum(trust).alias("trust"),
        F.max((F.col("direction") != "neutral").cast("int")).alias("directional"),
        F.count("*").alias("items"),
    )
    expected_in = F.col("family").isin(*expected)
    high = F.lit(len([f for f in HIGH_VALUE if f in expected]))
    other = F.lit(len([f for f in expected if f not in HIGH_VALUE]))
    folded = families.groupBy("request_id").agg(
        F.sum(clamp(F.col("raw"), -1, 1) * weight_of(F.col("family"))).alias("points"),
        F.sum("strength").alias("strength"),
        F.sum("trust").alias("trust"),
        F.sum("directional").alias("directional"),
        F.count_if(expected_in & F.col("family").isin(*HIGH_VALUE)).alias("high"),
        F.count_if(expected_in & ~F.col("family").isin(*HIGH_VALUE)).alias("other"),
        F.count("*").alias("families"),
        F.sum("items").alias("items"),
    )
    cover = coverage(high - F.col("high"), other - F.col("other"))
    score = F.bround(clamp(50 + F.col("points") * cover, 0, 100), 0).cast("int")
    quality = F.when(F.col("strength") > 0, F.col("trust") / F.col("strength")).otherwise(0.0)
    seen = (F.col("high") + F.col("other")) / len(expected) if expected else F.lit(1.0)
    sure = quality * (0.55 + 0.25 * seen + 0.20 * F.least(F.lit(1.0), F.col("directional") / 3.0))
    return folded.select(
        "request_id", score.alias("score"), direction_of(score).alias("direction"), F.bround(F.least(F.lit(0.95), sure), 4).alias("confidence"),
        cover.alias("coverage"), "families", "items",
    )


def direction_of(score: Column) -> Column:
    return F.when(score >= 55, "bullish").when(score <= 45, "bearish").otherwise("neutral")


def with_quiet_requests(requests: DataFrame, scored: DataFrame) -> DataFrame:
    """scored with a row for each request that has no evidence: 50, neutral, no confidence."""
    found = requests.select("request_id").join(scored, "request_id", "left")
    return found.fillna({"score": 50, "direction": "neutral", "confidence": 0.0, "coverage": LEAST_COVERAGE, "families": 0, "items": 0})
