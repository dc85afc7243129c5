"""Naming an intermediate value inside one expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    The optimizer merges neighbouring projections, and a column that a
    higher-order function refers to would then be computed again for every
    array entry. A lambda variable is bound by value.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
