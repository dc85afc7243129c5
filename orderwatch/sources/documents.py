"""Procedure documents and evaluation questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# File suffix and how its text is prepared.
SUFFIX_FORMATS = {"md": "markdown", "markdown": "markdown", "txt": "text", "html": "html", "htm": "html"}

QUESTION_SCHEMA = (
    "id string, question string, expected_intent string, relevant_sop string, "
    "expected_tools array<string>, difficulty string"
)


def read_documents(spark: SparkSession, folder: str, glob: str = "*.{md,markdown,txt,html,htm}") -> DataFrame:
    """One row per file under ``folder``: source, format and whole text.

    Files with other suffixes raise when the rows are read.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    whole = files.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("text"))
    return with_format(whole)


def with_format(files: DataFrame) -> DataFrame:
    """(source, format, text) of whole files; the source's suffix tells the format, an unknown one raises."""
    path = F.col("source")
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    kind = F.raise_error(F.concat(F.lit("unsupported file format: "), path)).cast("string")
    for name, prepared in SUFFIX_FORMATS.items():
        kind = F.when(suffix == name, prepared).otherwise(kind)
    return files.select("source", kind.alias("format"), "text")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation questions from JSON lines; blank lines are skipped."""
    return parse_questions(spark.read.text(path))


def parse_questions(lines: DataFrame) -> DataFrame:
    """Questions from lines (column ``value``); lines that hold no question with an id are left out."""
    rows = lines.select(F.from_json("value", QUESTION_SCHEMA).alias("q")).select("q.*").filter(F.col("id").isNotNull())
    return rows.withColumns(
        {
            "expected_tools": F.coalesce("expected_tools", F.array().cast("array<string>")),
            "difficulty": F.coalesce("difficulty", F.lit("easy")),
        }
    )
