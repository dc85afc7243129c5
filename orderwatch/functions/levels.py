"""P0..P3 bands."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lowest score (sellers) and lowest defect percentage (categories)
# that reach each level.
SCORE_BANDS = ((50, "P0"), (30, "P1"), (15, "P2"))
CATEGORY_BANDS = ((40, "P0"), (20, "P1"), (10, "P2"))


def band(value: Column, bands: Iterable[tuple[float, str]], default: str = "P3") -> Column:
    """First level whose lower bound ``value`` reaches."""
    level = F.lit(default)
    for lower, name in reversed(tuple(bands)):
        level = F.when(value >= lower, name).otherwise(level)
    return level


def score_level(value: Column) -> Column:
    return band(value, SCORE_BANDS)


def category_level(value: Column) -> Column:
    return band(value, CATEGORY_BANDS)
