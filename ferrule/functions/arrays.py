"""Expressions over arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once, however often use has it, within functions of elements too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
