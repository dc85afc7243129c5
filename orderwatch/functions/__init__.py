"""Column expressions shared by the operators (all JVM-side)."""

from .levels import band, category_level, score_level
from .numeric import as_double, as_int, as_timestamp, exact, exact_ratio, half_even, percent, ratio

__all__ = [
    "as_double",
    "as_int",
    "as_timestamp",
    "band",
    "category_level",
    "exact",
    "exact_ratio",
    "half_even",
    "percent",
    "ratio",
    "score_level",
]
