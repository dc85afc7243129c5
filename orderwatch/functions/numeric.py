"""Safe casts, guarded ratios and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def as_double(value: Column | str) -> Column:
    """Number or NULL; text that is not a number never fails the job."""
    return _column(value).try_cast("double")


def as_int(value: Column | str) -> Column:
    """Whole number or NULL, rounding texts such as ``4.0`` and ``4.5``."""
    return F.round(as_double(value)).try_cast("int")


def as_timestamp(value: Column | str) -> Column:
    """Timestamp in the dataset's one format, NULL for any other text."""
    return F.try_to_timestamp(_column(value), F.lit(TIMESTAMP_FORMAT))


def exact(value: Column, places: int = 6) -> Column:
    """The number as a decimal, so that sums do not depend on the order of addition.

    It is rounded to ``places`` decimal places, more than money has; NULL if it has more
    than ``28 - places`` digits before the point or is no number.
    """
    return value.try_cast(f"decimal(28,{places})")


def exact_ratio(total: Column, count: Column) -> Column:
    """The quotient of a decimal sum and a count, NULL where the count is zero or NULL."""
    return ratio(total.cast("double"), count)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, NULL where the denominator is zero or NULL."""
    return numerator / F.nullif(denominator, F.lit(0))


def percent(part: Column, whole: Column) -> Column:
    """Share in percent with two places, NULL for an empty whole."""
    return F.round(ratio(part * F.lit(100.0), whole), 2)


def half_even(value: Column, digits: int) -> Column:
    """Round the exact binary value, ties to even.

    ``round`` and ``bround`` both work on the shortest decimal text of a double
    and so move values like 12.35, which is stored slightly below the tie.
    ``format_number`` looks at the stored value.
    """
    text = F.format_number(value, digits)
    return F.regexp_replace(text, ",", "").cast("double")
