"""Blanks and accents of any script, as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: every character that counts as white space, as a regular expression class.
BLANK = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
# Combining marks, and the Latin letters that consist of a plain letter and marks.
MARKS = "".join(map(chr, range(0x300, 0x370)))
ACCENTED = "".join(
    c for c in map(chr, (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))) if len(unicodedata.normalize("NFD", c)) > 1
)
PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in ACCENTED)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def is_blank(text: Column) -> Column:
    return ~F.rlike(text, F.lit(BLANK.replace("[", "[^", 1)))


def words(text: Column) -> Column:
    """What stands between blanks."""
    return F.array_remove(F.split(text, f"{BLANK}+"), "")


def without_accents(text: Column) -> Column:
    """Latin letters without their accents, composed or not; marks vanish."""
    return F.translate(text, ACCENTED + MARKS, PLAIN)
