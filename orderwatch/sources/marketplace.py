"""The nine marketplace CSV tables: names, columns, reading and typing."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import as_timestamp
from ..session import new_path, stored
from .records import gathered, read_lines, with_quote_starts

# Fixed values of the public dataset: file and table names.
TABLE_FILES = {
    "orders": "olist_orders_dataset.csv",
    "order_items": "olist_order_items_dataset.csv",
    "order_payments": "olist_order_payments_dataset.csv",
    "order_reviews": "olist_order_reviews_dataset.csv",
    "products": "olist_products_dataset.csv",
    "sellers": "olist_sellers_dataset.csv",
    "customers": "olist_customers_dataset.csv",
    "geolocation": "olist_geolocation_dataset.csv",
    "category_translation": "product_category_name_translation.csv",
}

# Columns that hold times; everything else stays text and is cast where used.
TIME_COLUMNS = {
    "orders": (
        "order_purchase_timestamp",
        "order_approved_at",
        "order_delivered_carrier_date",
        "order_delivered_customer_date",
        "order_estimated_delivery_date",
    ),
    "order_items": ("shipping_limit_date",),
    "order_reviews": ("review_creation_date", "review_answer_timestamp"),
}

# Only review comments contain line breaks inside quotes. Spark's own reading across lines
# makes a file one task, so these records are put together from lines read in many.
MULTI_LINE_TABLES = frozenset({"order_reviews"})


def read_csv_table(spark: SparkSession, path: str, table: str) -> DataFrame | None:
    """One table with all columns as text and empty values as NULL.

    ``path`` may be a file or a folder of part files. Returns None if absent.
    """
    reader = spark.read.option("header", True).option("escape", '"')
    try:
        raw = reader.csv(path)
        if table in MULTI_LINE_TABLES and raw.columns:
            raw = _across_lines(spark, path, raw.columns)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return raw.select(*(F.nullif(F.col(f"`{c}`"), F.lit("")).alias(c) for c in raw.columns))


def _across_lines(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Records whose quoted values may hold line breaks. The first record of a file is its header."""
    # Written once: the starts of the records are used several times.
    lines = stored(with_quote_starts(read_lines(spark, path)), new_path(spark, "lines"))
    heads = lines.filter("start").groupBy("file").agg(F.min("at").alias("first"))
    rows = gathered(lines).join(heads, ["file", "first"], "left_anti").filter("record != ''")
    fields = ", ".join(f"c{i} STRING" for i in range(len(columns)))
    parsed = rows.select(F.from_csv("record", fields, {"escape": '"', "multiLine": "true"}).alias("r"))
    return parsed.select(*(F.col(f"r.c{i}").alias(c) for i, c in enumerate(columns)))


def type_times(table: str, df: DataFrame) -> DataFrame:
    """Parse the table's time columns value by value (bad text becomes NULL)."""
    present = [c for c in TIME_COLUMNS.get(table, ()) if c in df.columns]
    return df.withColumns({c: as_timestamp(c) for c in present})


def load_marketplace(spark: SparkSession, folder: str, files: Mapping[str, str] = TABLE_FILES) -> dict[str, DataFrame]:
    """Every table whose file exists, typed. Missing files are left out."""
    tables = {}
    for table, file_name in files.items():
        raw = read_csv_table(spark, f"{folder.rstrip('/')}/{file_name}", table)
        if raw is not None:
            tables[table] = type_times(table, raw)
    return tables


def unparsed_times(raw: Mapping[str, DataFrame]) -> DataFrame:
    """Per time column: filled texts and how many of them are no timestamp.

    ``raw`` holds tables as read by :func:`read_csv_table`, before typing.
    """
    counts = None
    for table, df in raw.items():
        columns = [c for c in TIME_COLUMNS.get(table, ()) if c in df.columns]
        if not columns:
            continue
        measures = []
        for c in columns:
            bad = F.count_if(F.col(c).isNotNull() & as_timestamp(c).isNull())
            measures.append(F.struct(F.lit(c).alias("column_name"), F.count(c).alias("filled"), bad.alias("unparsed")))
        part = df.agg(F.array(*measures).alias("m")).select(F.lit(table).alias("table_name"), F.inline("m"))
        counts = part if counts is None else counts.unionByName(part)
    if counts is None:
        raise ValueError("no table with a time column")
    return counts
