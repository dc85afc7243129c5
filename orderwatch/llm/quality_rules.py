"""Quality rules whose thresholds come from quantile sketches of the data.

Fixed cutoffs are replaced by fences of each (language, source) group: a measure is
an outlier if it lies beyond the group's median by more than ``reach`` times its
upper (or lower) half-spread, the distance from the median to the ``tail`` quantile,
with a least spread so that a group of equal values does not reject small changes.

Quantiles come from mergeable sketches: a measure is cut to a logarithmic bin of
relative width GAMMA - 1, and a sketch is the count of rows in each bin. Sketches
merge by adding counts, so they are built before the shuffle, a group that holds a
third of all rows costs no more than any other, and a group below ``min_rows`` uses
the merged sketch of its language, or of all rows. Only built-in column functions are
used.

Defined results: NULL and empty texts have no words, fail the base rule and are in no
sketch; NULL language or source is a group of its own; repeated rows count each time and
are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import let
from .shared import stored

BLANKS = " \t\n\u000b\f\r"
SYMBOLS = "#*$%&|<>"
SPAN = 8
GAMMA = 1.05
SMALLEST = 1e-4
MIN_ROWS = 200

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÂÄÇÉÈÊËÎÏÔÖÙÛÜÁÍÓÚÑ"
MARKS = ".,;:!?\"'()-"
MAX_BROADCAST_GROUPS = 100_000

# measure: reach and least spread of the fence above the median, and below it.
FENCES = {
    "symbol_share": ((8.0, 0.01), None),
    "word_length": ((8.0, 0.25), (8.0, 0.25)),
    "capital_share": ((8.0, 0.02), None),
    "mark_share": ((8.0, 0.01), None),
    "repeat_share": ((8.0, 0.03), None),
    "dup_line_share": ((8.0, 0.05), None),
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def _words(text: Column) -> Column:
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def _repeat_words(words: Column) -> Column:
    """Words inside 8-word windows that occur twice or more, the first included."""

    def covered(places: Column) -> Column:
        # Windows overlap: each start adds the words up to the next start, 8 at most.
        steps = F.transform(places, lambda p, k: F.least(F.lit(SPAN), F.coalesce(F.get(places, k + 1) - p, F.lit(SPAN))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def sorted_starts(marks: Column) -> Column:
        twice = F.filter(marks, lambda m, k: (F.get(marks, k - 1)["h"] == m["h"]) | (F.get(marks, k + 1)["h"] == m["h"]))
        return F.array_sort(F.transform(twice, lambda m: m["at"]))

    def spread(hashes: Column) -> Column:
        marks = F.array_sort(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), k.alias("at"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            let(marks, lambda m: let(sorted_starts(m), covered))
        )

    def of(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(w) - (SPAN - 1)), lambda k: F.xxhash64(F.slice(w, k, SPAN)))
        return let(windows, spread)

    return F.when(F.size(words) <= SPAN, F.lit(0)).otherwise(of(words))


def measures(docs: DataFrame) -> DataFrame:
    """The counts of the base rules and the shares that the fences judge.

    The row that they belong to is the struct ``doc``.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    solid = F.translate(text, BLANKS, "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)

    def word_counts(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
        )

    def line_counts(x: Column) -> Column:
        return F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    def char_counts(s: Column) -> Column:
        return F.struct(
            F.length(s).cast("long").alias("word_chars"),
            (F.length(s) - F.length(F.translate(s, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.length(s) - F.length(F.translate(s, CAPITALS, ""))).alias("n_capitals"),
            (F.length(s) - F.length(F.translate(s, MARKS, ""))).alias("n_marks"),
        )

    rows = docs.select(F.struct("*").alias("doc"), let(_words(text), word_counts).alias("w"), let(lines, line_counts).alias("l"), let(solid, char_counts).alias("c"))
    rows = rows.select("doc", "w.*", "l.*", "c.*")
    n_words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return rows.select(
        "doc", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
        (F.col("n_symbols") / chars).alias("symbol_share"),
        (F.col("word_chars") / n_words).alias("word_length"),
        (F.col("n_capitals") / chars).alias("capital_share"),
        (F.col("n_marks") / chars).alias("mark_share"),
        (F.col("n_repeat_words") / n_words).alias("repeat_share"),
        (F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("dup_line_share"),
    )


def bin_of(value: Column) -> Column:
    """Bin 0 holds values below SMALLEST, bin k those up to SMALLEST * GAMMA**k."""
    return F.when(value < SMALLEST, F.lit(0)).otherwise(1 + F.floor(F.ln(value / SMALLEST) / F.ln(F.lit(GAMMA)))).cast("int")


def value_of(bin_number: Column) -> Column:
    """The middle of a bin."""
    return F.when(bin_number == 0, F.lit(0.0)).otherwise(F.lit(SMALLEST) * F.pow(F.lit(GAMMA), bin_number - 0.5))


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, measure, bin, n): one mergeable sketch per group and measure."""
    bins = F.array(*[F.struct(F.lit(n).alias("measure"), bin_of(F.col(n)).alias("bin")) for n in FENCES])
    binned = rows.filter("n_words > 0").select(F.col("doc.lang").alias("lang"), F.col("doc.source").alias("source"), F.inline(bins))
    return binned.groupBy("lang", "source", "measure", "bin").agg(F.count("*").alias("n"))


def _quantiles(sketch: DataFrame, *keys: str) -> DataFrame:
    """Quarter, half and three-quarter quantile of each sketch, and its rows."""
    group = [*keys, "measure"]
    merged = sketch.groupBy(*group, "bin").agg(F.sum("n").alias("n"))
    merged = merged.withColumn("upto", F.sum("n").over(Window.partitionBy(*group).orderBy("bin")))
    merged = merged.withColumn("rows", F.sum("n").over(Window.partitionBy(*group)))
    at = [value_of(F.min(F.when(F.col("upto") >= F.col("rows") * q, F.col("bin")))) for q in (0.25, 0.5, 0.75)]
    return merged.groupBy(*group).agg(F.max("rows").alias("rows"), F.struct(*[v.alias(n) for v, n in zip(at, ("q25", "q50", "q75"))]).alias("q"))


def thresholds(sketch: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """One row per group: ``high`` and ``low`` fences by measure.

    A group with fewer than ``min_rows`` rows takes the fences of its language,
    and of all rows if that is small too.
    """
    groups, languages, whole = _quantiles(sketch, "lang", "source").alias("g"), _quantiles(sketch, "lang").alias("l"), _quantiles(sketch).alias("w")
    joined = groups.join(languages, F.col("g.lang").eqNullSafe(F.col("l.lang")) & (F.col("g.measure") == F.col("l.measure"))).join(whole, F.col("g.measure") == F.col("w.measure"))
    q = F.when(F.col("g.rows") >= min_rows, F.col("g.q")).when(F.col("l.rows") >= min_rows, F.col("l.q")).otherwise(F.col("w.q"))
    chosen = joined.select(F.col("g.lang").alias("lang"), F.col("g.source").alias("source"), F.col("g.measure").alias("measure"), q.alias("q"))

    def fences(side: int) -> Column:
        found = []
        for name, sides in FENCES.items():
            if sides[side]:
                reach, least = sides[side]
                spread = F.col("q.q75") - F.col("q.q50") if side == 0 else F.col("q.q50") - F.col("q.q25")
                fence = F.col("q.q50") + (reach if side == 0 else -reach) * F.greatest(spread, F.lit(least))
                found.append(F.max(F.when(F.col("measure") == name, fence)).alias(name))
        return F.struct(*found)

    return chosen.groupBy("lang", "source").agg(fences(0).alias("high"), fences(1).alias("low"))


def verdict(rows: DataFrame, fences: DataFrame) -> DataFrame:
    """``rows`` with ``kept``: no base rule failed and every measure inside its fences."""
    if fences.count() <= MAX_BROADCAST_GROUPS:
        fences = F.broadcast(fences)
    same = F.col("doc.lang").eqNullSafe(F.col("lang")) & F.col("doc.source").eqNullSafe(F.col("source"))
    inside = ~F.col("base_failed")
    for name, (high, low) in FENCES.items():
        if high:
            inside &= F.col(name) <= F.col(f"high.{name}")
        if low:
            inside &= F.col(name) >= F.col(f"low.{name}")
    return rows.join(fences, same, "left").withColumn("kept", F.coalesce(inside, F.lit(False))).drop("lang", "source", "high", "low")


def judge(docs: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """(doc_id, lang, source, the counts, kept) for each row; texts are measured once."""
    rows = stored(measures(docs.select("doc_id", "text", "lang", "source")).withColumn("doc", F.col("doc").dropFields("text")), "measures")
    fences = stored(thresholds(sketches(rows), min_rows), "fences")
    return verdict(rows, fences).select("doc.doc_id", "doc.lang", "doc.source", *COUNTS, "kept")


def keep(docs: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns.

    Texts are measured twice and never shuffled.
    """
    narrow = docs.select("text", "lang", "source")
    fences = stored(thresholds(sketches(measures(narrow)), min_rows), "fences")
    return verdict(measures(docs), fences).filter("kept").select("doc.*")
