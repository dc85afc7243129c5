"""Source-file and catalog audits."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .marketplace import TABLE_FILES

MISSING, UNREADABLE, EMPTY, NO_ROWS = (
    "File not found",
    "Not valid UTF-8",
    "File is empty",
    "Fewer than 2 non-blank lines",
)


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def audit_files(spark: SparkSession, folder: str, expected: Iterable[str] | None = None) -> DataFrame:
    """One row per expected file: is it there, and what is wrong with it.

    Lines are counted per file with map-side partial sums, so one file that
    holds most of the data is still read by many tasks.
    """
    names = list(TABLE_FILES.values()) if expected is None else list(expected)
    root = folder.rstrip("/")
    there = [(n, _exists(spark, f"{root}/{n}")) for n in names]
    wanted = spark.createDataFrame(there, "file_name string, present boolean")
    paths = [f"{root}/{n}" for n, present in there if present]
    if not paths:
        return wanted.select("file_name", "present", F.lit(MISSING).alias("problem"))
    text = F.col("value")
    # empty files give no rows, a folder of part files counts as one file
    name = F.regexp_extract("_metadata.file_path", "|".join(re.escape(n) + "(?=/|$)" for n in names), 0)
    per_file = (
        spark.read.text(paths)
        .select(name.alias("file_name"), "value")
        .groupBy("file_name")
        .agg(
            F.count_if(F.length(F.trim(F.make_valid_utf8(text))) > 0).alias("filled_lines"),
            F.count_if(~F.is_valid_utf8(text)).alias("broken_lines"),
        )
    )
    problem = (
        F.when(~F.col("present"), MISSING)
        .when(F.coalesce("broken_lines", F.lit(0)) > 0, UNREADABLE)
        .when(F.coalesce("filled_lines", F.lit(0)) == 0, EMPTY)
        .when(F.col("filled_lines") < 2, NO_ROWS)
    )
    return wanted.join(per_file, "file_name", "left").select("file_name", "present", problem.alias("problem"))


def catalog_counts(tables: Mapping[str, DataFrame], marts: Mapping[str, DataFrame]) -> DataFrame:
    """Row count of every base table and mart as (name, kind, n_rows)."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("name"), F.lit(kind).alias("kind"), "n_rows")
        for kind, group in (("table", tables), ("mart", marts))
        for name, df in group.items()
    ]
    if not parts:
        raise ValueError("nothing to count")
    return reduce(DataFrame.unionByName, parts)


def catalog_status(spark: SparkSession, tables: Mapping[str, DataFrame], marts: Mapping[str, DataFrame]) -> DataFrame:
    """``ok``, ``warning`` or ``missing`` with the issues that led to it."""
    issues = []
    if not tables:
        issues.append("No base tables found")
    if not marts:
        issues.append("No marts found")
    status = "missing" if not tables and not marts else "warning" if issues else "ok"
    return spark.createDataFrame([(status, issues)], "status string, issues array<string>")
