"""Records of several lines, put together from files that are read in many parts.

Lines are read split by split and dealt to blocks of at most BLOCK_LINES lines of a split. Whether a line
starts a record may depend on the lines before it, so each block is summed up in one row, the blocks of a
file are put in order, and what the blocks before it leave open is handed to each. Only these
rows, one for each block, meet in a window over a file; a record is gathered from its lines, wherever they were read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

BLOCK_LINES = 1 << 15
BLOCK = ["file", "block", "part"]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, part, at, line): lines with the split and the block of it they were read in, and their order."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        F.regexp_replace("value", "\r$", "").alias("line"),
    )
    return lines.select("file", "block", F.floor(F.col("at") / BLOCK_LINES).alias("part"), "at", "line")


def with_quote_starts(lines: DataFrame) -> DataFrame:
    """Adds ``start``: the line does not stand inside quotes. Doubled quotes leave the state as it is."""
    odd = (F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))) % 2
    marked = lines.withColumn("odd", odd)
    before_block = Window.partitionBy("file").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = marked.groupBy(*BLOCK).agg(F.sum("odd").alias("quotes"))
    carried = blocks.select(*BLOCK, F.coalesce(F.sum("quotes").over(before_block), F.lit(0)).alias("carried"))
    before_line = Window.partitionBy(*BLOCK).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    inside = (F.col("carried") + F.coalesce(F.sum("odd").over(before_line), F.lit(0))) % 2
    return marked.join(carried, BLOCK).withColumn("start", inside == 0).drop("odd", "carried")


def gathered(lines: DataFrame) -> DataFrame:
    """(file, first, record): the text from each line with ``start`` to the next, lines before any start left out.

    ``first`` orders the records of a file.
    """
    so_far = Window.partitionBy(*BLOCK).orderBy("at")
    before_block = Window.partitionBy("file").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, -1)
    begins = F.when(F.col("start"), F.col("at"))
    last = lines.groupBy(*BLOCK).agg(F.max(begins).alias("last"))
    carried = last.select(*BLOCK, F.last("last", ignorenulls=True).over(before_block).alias("carried"))
    placed = lines.withColumn("own", F.max(begins).over(so_far)).join(carried, BLOCK)
    placed = placed.select("file", F.coalesce("own", "carried").alias("first"), F.struct("at", "line").alias("part"))
    record = F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["line"]), "\n")
    return placed.filter("first is not null").groupBy("file", "first").agg(record.alias("record"))


def stripped_of_commas(record: Column) -> Column:
    """A JSON record without the brackets and commas of the array around it."""
    return F.regexp_replace(F.regexp_replace(record, r"^[\s,\[]+", ""), r"[\s,\]]+$", "")
