"""Task snapshots and evaluation reports on shared storage."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tasks import TASK_COLUMNS, TASK_SCHEMA
from .records import gathered, read_lines, stripped_of_commas

# What stands before a record of an array: a brace and a quoted name with a colon, which no JSON string can
# hold because its quotes are escaped, or a brace that begins a line, since strings have no line breaks.
BETWEEN = r'[\s,]*(?=\{\s*"[^"\\]*"\s*:)|\s*[\r\n][\s,]*(?=\{)'


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], TASK_SCHEMA)


def parse_task_json(texts: DataFrame) -> DataFrame:
    """Tasks from JSON texts (column ``value``): arrays, lines of records or parts of either.

    Column ``broken`` counts the records of a text that cannot be parsed or have no id; a text
    with broken records only gives one row without a task. A broken record costs no other one.
    """
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")
    is_array = F.ltrim("value").startswith("[")
    body = stripped_of_commas(F.col("value"))
    listed = F.from_json(F.concat(F.lit("["), body, F.lit("]")), f"array<struct<{_fields()}>>")
    # where the array as a whole is broken, its records are told apart by what stands between them
    pieces = F.filter(F.split(body, BETWEEN), lambda x: F.trim(x) != "")
    single = F.transform(F.when(is_array, pieces).otherwise(lines), lambda x: F.from_json(x, TASK_SCHEMA))
    whole = is_array & listed.isNotNull() & ~F.exists(listed, lambda t: t.isNull() | t["task_id"].isNull())
    rows = texts.select(F.when(whole, listed).otherwise(single).alias("tasks"))
    good = F.filter("tasks", lambda t: t["task_id"].isNotNull())
    rows = rows.select(good.alias("good"), (F.size("tasks") - F.size(good)).alias("broken"))
    return rows.filter("size(good) > 0 or broken > 0").select(F.explode_outer("good").alias("task"), "broken")


def _fields() -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (f.strip().split(" ", 1) for f in TASK_SCHEMA.split(",")))


def task_records(spark: SparkSession, path: str) -> DataFrame:
    """Column ``value``: pieces of JSON files that hold whole records, read by many tasks.

    A JSON text has no line break inside a string, and a task holds no other object, so a line
    that begins with a brace, after brackets and commas, starts a record.
    """
    lines = read_lines(spark, path).withColumn("start", F.rlike("line", F.lit(r"^[\s,\[]*\{")))
    records = gathered(lines).select(stripped_of_commas(F.col("record")).alias("record"))
    return records.select(F.concat(F.lit("["), "record", F.lit("]")).alias("value"))


def read_task_json(spark: SparkSession, path: str) -> DataFrame:
    """Tasks from JSON (an array or one record per line); missing means none.

    Records that cannot be parsed are left out; ``parse_task_json`` counts them.
    """
    try:
        texts = task_records(spark, path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return _empty(spark)
        raise
    return parse_task_json(texts).filter("task is not null").select(*[F.col(f"task.{c}").alias(c) for c in TASK_COLUMNS])


def write_snapshot(tasks: DataFrame, root: str, version: int) -> None:
    """Write a new version and then publish it.

    Readers follow the list of published versions, so they never see a version
    whose data is still being written. One writer at a time is assumed.
    """
    tasks.select(*TASK_COLUMNS).write.mode("overwrite").parquet(f"{root}/data/version={version}")
    published = tasks.sparkSession.createDataFrame([(version,)], "version long")
    published.coalesce(1).write.mode("append").json(f"{root}/published")


def latest_version(spark: SparkSession, root: str) -> int | None:
    try:
        versions = spark.read.schema("version long").json(f"{root}/published")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return versions.agg(F.max("version").alias("v")).first()["v"]


def read_snapshot(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The latest published version (or a given one); none yet means empty."""
    version = latest_version(spark, root) if version is None else version
    if version is None:
        return _empty(spark)
    return spark.read.schema(TASK_SCHEMA).parquet(f"{root}/data/version={version}")


def write_report(tables: Mapping[str, DataFrame], folder: str, file_format: str = "parquet") -> None:
    """Write each report table into its own sub-folder."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).format(file_format).save(f"{folder.rstrip('/')}/{name}")
