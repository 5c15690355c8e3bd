"""Arithmetic of scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The quantile of the one-sided 95 % bound.
Z95 = 1.6448536269514722


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), x))


def seconds_between(later: Column, earlier: Column) -> Column:
    """Exact seconds between two timestamps, with their fraction."""
    return F.timestamp_diff("MICROSECOND", earlier, later) / 1e6


def recency(ts: Column, as_of: Column, lookback_days: Column) -> Column:
    """1 at as_of and after, falling to 0 at the end of the lookback."""
    age = F.greatest(F.lit(0.0), seconds_between(as_of, ts) / 86400)
    return F.greatest(F.lit(0.0), 1 - age / lookback_days)


def finite(text: Column) -> Column:
    """A number, or null for junk, NaN and infinities."""
    x = text.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def wilson_lower(successes: Column, total: Column) -> Column:
    """Lower bound of a share; 0 of nothing."""
    n, p = total.cast("double"), successes / total
    margin = Z95 * F.sqrt((p * (1 - p) + Z95 * Z95 / (4 * n)) / n)
    bound = (p + Z95 * Z95 / (2 * n) - margin) / (1 + Z95 * Z95 / n)
    return F.when(total > 0, F.greatest(F.lit(0.0), bound)).otherwise(0.0)
