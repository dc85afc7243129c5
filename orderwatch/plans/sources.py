"""Readers and sinks over text made from the tables, whole and with broken values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents as elements
from ..operators import marts
from ..session import new_path
from ..sources import documents, marketplace, store
from ..sources.audit import audit_files, catalog_counts
from ..sources.star import load_star, read_table
from .base import clock, query_sql
from .documents import element_views, shown, texts

TIME = "yyyy-MM-dd HH:mm:ss"


def _text_orders(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Orders as a CSV file has them: times as text, some of them broken or empty."""
    orders = load_star(spark, folder)["orders"]
    key = F.col("order_id")

    def text(name: str):
        return F.when(key % 7 == 0, "soon").when(key % 11 == 0, None).otherwise(F.date_format(name, TIME)).alias(name)

    names = ("order_purchase_timestamp", "order_delivered_customer_date")
    return {"orders": orders.select("order_id", *map(text, names))}


def typed_times(spark: SparkSession, folder: str) -> DataFrame:
    typed = marketplace.type_times("orders", _text_orders(spark, folder)["orders"])
    return typed.select("order_id", clock("order_purchase_timestamp"), clock("order_delivered_customer_date"))


def unparsed_times(spark: SparkSession, folder: str) -> DataFrame:
    return marketplace.unparsed_times(_text_orders(spark, folder))


def csv_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """Reviews written as CSV with line breaks and quotes inside values, and read again."""
    key = F.col("o_orderkey").cast("string")
    message = F.concat(F.lit('first "line" of '), key, F.lit("\n\n, second, "), "o_orderpriority", F.lit("\n"))
    rows = read_table(spark, folder, "orders").select(
        F.concat(F.lit("r"), key).alias("review_id"), key.alias("order_id"), message.alias("review_comment_message"),
        F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.date_format("o_orderdate", TIME)).alias("review_creation_date"),
    )
    path = new_path(spark, "reviews.csv")
    rows.write.option("header", True).option("escape", '"').option("quoteAll", True).option("ignoreTrailingWhiteSpace", False).csv(path)
    read = marketplace.type_times("order_reviews", marketplace.read_csv_table(spark, path, "order_reviews"))
    return read.select("review_id", "order_id", "review_comment_message", clock("review_creation_date"))


def marts_of_present_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Without reviews only the mart that needs none is built."""
    tables = {n: t for n, t in load_star(spark, folder).items() if n != "order_reviews"}
    return catalog_counts({}, marts.build_marts(tables))


def file_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Binary files are no text, and one file is missing."""
    return audit_files(spark, folder, ["orders.parquet", "documents.parquet", "absent.csv"])


def question_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Questions from JSON lines, some of them blank, cut off or without a level."""
    number = F.col("item_id")
    tools = F.when(number % 3 == 0, F.array(F.lit("search"), F.lit("metric")))
    level = F.when(number % 2 == 0, "hard")
    line = F.to_json(F.struct(number.cast("string").alias("id"), F.col("text").alias("question"), tools.alias("expected_tools"), level.alias("difficulty")))
    value = F.when(number % 5 == 0, "").when(number % 7 == 0, F.substring(line, 1, 20)).otherwise(line)
    rows = documents.parse_questions(read_table(spark, folder, "benchmark").select(value.alias("value")))
    return rows.select("id", "question", F.array_join("expected_tools", ",").alias("expected_tools"), "difficulty")


def file_formats(spark: SparkSession, folder: str) -> DataFrame:
    """Formats by the suffix of a file's name."""
    suffix = F.element_at(F.array(*map(F.lit, (".md", ".TXT", ".html", ".htm", ".markdown"))), (F.col("page_id") % 5 + 1).cast("int"))
    files = read_table(spark, folder, "pages").select(F.concat("url", suffix).alias("source"), F.col("html").alias("text"))
    return documents.with_format(files).select("source", "format", F.length("text").alias("n_chars"))


def mixed_elements(spark: SparkSession, folder: str) -> DataFrame:
    """Every second document as plain text, which is one element."""
    number = F.regexp_extract("source", r"([0-9]+)$", 1).cast("long")
    docs = texts(spark, folder).withColumn("format", F.when(number % 2 == 0, "text").otherwise("markdown"))
    return shown(elements.elements(docs))


def task_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Tasks from JSON arrays, one for each customer's orders, some with a broken record."""
    key = F.col("o_orderkey").cast("string")
    record = F.to_json(F.struct(F.concat(F.lit("RT-"), key).alias("task_id"), F.col("o_orderstatus").alias("status"), F.concat(F.lit("}, { "), "o_orderpriority").alias("title")))
    record = F.when(F.col("o_orderkey") % 13 == 0, '{"task_id": ').otherwise(record)
    lists = read_table(spark, folder, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list(record)), ",\n").alias("records"))
    found = store.parse_task_json(lists.select(F.concat(F.lit("["), "records", F.lit("]")).alias("value")))
    return found.groupBy("task.task_id", "task.status", "task.title").agg(F.sum("broken").alias("broken"))


def report_tables(spark: SparkSession, folder: str) -> DataFrame:
    """A report table written and read again."""
    path = new_path(spark, "report")
    counts = read_table(spark, folder, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n_orders"))
    store.write_report({"orders_by_priority": counts}, path)
    return spark.read.parquet(f"{path}/orders_by_priority")


QUERIES = {
    f.__name__: f
    for f in (
        typed_times, unparsed_times, csv_reviews, marts_of_present_tables, file_audit, question_lines, file_formats, mixed_elements,
        task_texts, report_tables,
    )
}

# ------------------------------------------------------------------ SQL twins


def _time(column: str, name: str) -> str:
    return f"CASE WHEN order_id % 7 <> 0 AND order_id % 11 <> 0 THEN strftime({column}, '%Y-%m-%d %H:%M:%S') END AS {name}"


def _counted(column: str, name: str) -> str:
    return f"""SELECT 'orders' AS table_name, '{name}' AS column_name, count(*) FILTER (order_id % 7 = 0 OR order_id % 11 <> 0 AND {column} IS NOT NULL) AS filled,
                      count(*) FILTER (order_id % 7 = 0) AS unparsed FROM m_orders"""


ORACLES = {
    "typed_times": query_sql(f"SELECT order_id, {_time('purchased', 'order_purchase_timestamp')}, {_time('arrived', 'order_delivered_customer_date')} FROM m_orders"),
    "unparsed_times": query_sql(f"{_counted('purchased', 'order_purchase_timestamp')} UNION ALL {_counted('arrived', 'order_delivered_customer_date')}"),
    "csv_reviews": """
        SELECT 'r' || o_orderkey AS review_id, CAST(o_orderkey AS VARCHAR) AS order_id,
               'first "line" of ' || o_orderkey || chr(10) || chr(10) || ', second, ' || o_orderpriority || chr(10) AS review_comment_message,
               CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS review_creation_date
        FROM orders""",
    "marts_of_present_tables": query_sql(
        "SELECT 'seller_delivery_metrics' AS name, 'mart' AS kind, count(DISTINCT seller_id) AS n_rows FROM m_items JOIN m_sellers USING (seller_id)"
    ),
    "file_audit": """
        SELECT * FROM (VALUES ('orders.parquet', true, 'Not valid UTF-8'), ('documents.parquet', true, 'Not valid UTF-8'),
                              ('absent.csv', false, 'File not found')) AS t(file_name, present, problem)""",
    "question_lines": """
        SELECT CAST(item_id AS VARCHAR) AS id, text AS question, CASE WHEN item_id % 3 = 0 THEN 'search,metric' ELSE '' END AS expected_tools,
               CASE WHEN item_id % 2 = 0 THEN 'hard' ELSE 'easy' END AS difficulty
        FROM benchmark WHERE item_id % 5 <> 0 AND item_id % 7 <> 0""",
    "file_formats": """
        SELECT url || ['.md', '.TXT', '.html', '.htm', '.markdown'][page_id % 5 + 1] AS source,
               ['markdown', 'text', 'html', 'html', 'markdown'][page_id % 5 + 1] AS format, CAST(length(html) AS INTEGER) AS n_chars FROM pages""",
    "mixed_elements": query_sql(
        """SELECT source, section, CAST(page AS INTEGER) AS page, content_type, substr(sha1(concat_ws('|', source, section, text)), 1, 12) AS element_id,
                  length(text) AS n_chars, md5(text) AS text_md5 FROM el_elements
           UNION ALL SELECT source, '', 0, 'paragraph', substr(sha1(concat_ws('|', source, '', plain)), 1, 12), length(plain), md5(plain)
           FROM (SELECT source || '/' || doc_id AS source, trim(text, ' ' || chr(9) || chr(10) || chr(31) || chr(160) || chr(12288)) AS plain
                 FROM documents WHERE doc_id % 2 = 0) WHERE plain <> ''""",
        **element_views("SELECT source || '/' || doc_id AS source, text FROM documents WHERE doc_id % 2 <> 0", "el", True),
    ),
    "task_texts": """
        SELECT 'RT-' || o_orderkey AS task_id, o_orderstatus AS status, '}, { ' || o_orderpriority AS title,
               CAST(n AS BIGINT) AS broken
        FROM orders JOIN (SELECT o_custkey, count(*) FILTER (o_orderkey % 13 = 0) AS n FROM orders GROUP BY o_custkey) USING (o_custkey)
        WHERE o_orderkey % 13 <> 0
        UNION ALL
        SELECT NULL, NULL, NULL, CAST(sum(n) AS BIGINT) FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey
            HAVING count(*) FILTER (o_orderkey % 13 <> 0) = 0) HAVING count(*) > 0""",
    "report_tables": "SELECT o_orderpriority, count(*) AS n_orders FROM orders GROUP BY o_orderpriority",
}
