"""Marketplace tables derived from a star schema (orders, lineitem, part, ...).

The star schema has no reviews, delivery promises or cancellations. They are
computed by arithmetic on its columns, row by row, so every derived table keeps
the size and the partitioning of its source.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Review texts, picked by order key.
REVIEW_MESSAGES = (
    "slow delivery, parcel delayed by days",
    "item broken and leaking, 漏液",
    "seller rude, no reply, refund refused",
    "overpriced and not worth it",
    "all good, thank you",
)


def _days(column: Column, days: Column | int) -> Column:
    days = F.lit(days) if isinstance(days, int) else days
    return column + F.make_dt_interval(days.cast("int"))


# Column types of the source tables. Reading with a given schema needs no job.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder.rstrip('/')}/{name}.parquet")


def orders(spark: SparkSession, folder: str) -> DataFrame:
    source = read_table(spark, folder, "orders")
    status = (
        F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT"), "canceled")
        .when((F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "5-LOW"), "shipped")
        .otherwise("delivered")
    )
    bought = F.col("o_orderdate")
    arrived = _days(bought, F.col("o_orderkey") * 31 % 40) + F.expr("INTERVAL 16 HOURS")
    return source.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        status.alias("order_status"),
        bought.alias("order_purchase_timestamp"),
        bought.alias("order_approved_at"),
        F.when(status == "delivered", arrived).alias("order_delivered_customer_date"),
        _days(bought, 35).alias("order_estimated_delivery_date"),
    ).withColumn("order_delivered_carrier_date", F.col("order_delivered_customer_date"))


def order_items(spark: SparkSession, folder: str) -> DataFrame:
    price = F.col("l_extendedprice") / 100.0
    return read_table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_shipdate").alias("shipping_limit_date"),
        price.alias("price"),
        (price * F.col("l_tax") * (1 + F.col("l_suppkey") % 10)).alias("freight_value"),
    )


def order_payments(spark: SparkSession, folder: str) -> DataFrame:
    flag = F.col("l_returnflag")
    kind = F.when(flag == "A", "voucher").when(flag == "N", "credit_card").otherwise("boleto")
    value = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    return read_table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("payment_sequential"),
        kind.alias("payment_type"),
        F.lit(1).alias("payment_installments"),
        value.alias("payment_value"),
    )


def order_reviews(spark: SparkSession, folder: str) -> DataFrame:
    """One review for most orders and an older five-star one for some of them.

    Both come out of a single scan: each order yields the kinds of review it has.
    """
    key, total, bought = F.col("o_orderkey"), F.col("o_totalprice"), F.col("o_orderdate")
    older = F.col("kind") == "q"
    score = F.when(total < 25000, 1).when(total < 50000, 2).when(total < 200000, 3).when(total < 350000, 4).otherwise(5)
    message = F.element_at(F.array(*map(F.lit, REVIEW_MESSAGES)), (key % 5 + 1).cast("int"))
    usual = F.when(key % 17 != 0, F.array(F.lit("r"))).otherwise(F.array().cast("array<string>"))
    kinds = F.when(key % 23 == 0, F.concat(usual, F.array(F.lit("q")))).otherwise(usual)
    created = F.col("review_creation_date")
    return (
        read_table(spark, folder, "orders")
        .select("*", F.explode(kinds).alias("kind"))
        .withColumn("review_creation_date", _days(bought, F.when(older, 40).otherwise(45)))
        .select(
            F.concat("kind", key.cast("string")).alias("review_id"),
            key.alias("order_id"),
            F.when(older, 5).otherwise(score).alias("review_score"),
            F.lit(None).cast("string").alias("review_comment_title"),
            message.alias("review_comment_message"),
            created,
            _days(created, key % 5).alias("review_answer_timestamp"),
        )
    )


def products(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_type").alias("product_category_name"),
        (F.col("p_size") * 100).alias("product_weight_g"),
        (F.col("p_size") % 6).alias("product_photos_qty"),
    )


def _located(spark: SparkSession, folder: str, name: str, key: str, prefix: str) -> DataFrame:
    # 25 nations and 5 regions: a fixed size, and Spark sees it from the files.
    places = read_table(spark, folder, "nation").join(
        read_table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    source = read_table(spark, folder, name)
    return source.join(places, source[f"{key[0]}_nationkey"] == F.col("n_nationkey")).select(
        F.col(key).alias(f"{prefix}_id"),
        F.col("n_name").alias(f"{prefix}_city"),
        F.col("r_name").alias(f"{prefix}_state"),
    )


def sellers(spark: SparkSession, folder: str) -> DataFrame:
    return _located(spark, folder, "supplier", "s_suppkey", "seller")


def customers(spark: SparkSession, folder: str) -> DataFrame:
    return _located(spark, folder, "customer", "c_custkey", "customer")


READERS = {r.__name__: r for r in (orders, order_items, order_payments, order_reviews, products, sellers, customers)}


class StarTables(Mapping):
    """The derived tables by name, each defined when it is first asked for."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self._spark, self._folder = spark, folder
        self._known: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._known:
            self._known[name] = READERS[name](self._spark, self._folder)
        return self._known[name]

    def __iter__(self) -> Iterator[str]:
        return iter(READERS)

    def __len__(self) -> int:
        return len(READERS)


def load_star(spark: SparkSession, folder: str) -> Mapping[str, DataFrame]:
    """All derived tables, lazily."""
    return StarTables(spark, folder)
