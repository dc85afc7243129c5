"""Shared parts of the registered queries: result shaping and SQL views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import half_even


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    """Round the stored binary value, ties to even, as both engines do when they print it."""
    return df.withColumns({n: half_even(F.col(n), digits) for n in names})


def clock(name: str) -> Column:
    """A time as text, so that both engines print it alike."""
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


# SQL views of the derived marketplace tables, written independently of the
# DataFrame code. Each entry may use the ones before it.
VIEWS = {
    "m_orders": """
        SELECT *, CASE WHEN order_status = 'delivered'
                       THEN purchased + to_days(CAST(order_id * 31 % 40 AS INTEGER)) + INTERVAL 16 HOUR END AS arrived,
               purchased + INTERVAL 35 DAY AS promised
        FROM (SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS purchased,
                     CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN 'canceled'
                          WHEN o_orderstatus = 'O' AND o_orderpriority = '5-LOW' THEN 'shipped'
                          ELSE 'delivered' END AS order_status
              FROM orders)""",
    "m_items": """
        SELECT l_orderkey AS order_id, l_partkey AS product_id, l_suppkey AS seller_id,
               l_extendedprice / 100.0 AS price,
               l_extendedprice / 100.0 * l_tax * (1 + l_suppkey % 10) AS freight
        FROM lineitem""",
    "m_payments": """
        SELECT l_orderkey AS order_id,
               CASE l_returnflag WHEN 'A' THEN 'voucher' WHEN 'N' THEN 'credit_card' ELSE 'boleto' END AS kind,
               l_extendedprice * (1 - l_discount) * (1 + l_tax) AS paid
        FROM lineitem""",
    "m_reviews": """
        SELECT order_id, review_id, score, created, created + to_days(CAST(order_id % 5 AS INTEGER)) AS answered,
               CASE order_id % 5 WHEN 0 THEN 'slow delivery, parcel delayed by days'
                    WHEN 1 THEN 'item broken and leaking, 漏液' WHEN 2 THEN 'seller rude, no reply, refund refused'
                    WHEN 3 THEN 'overpriced and not worth it' ELSE 'all good, thank you' END AS message
        FROM (SELECT o_orderkey AS order_id, 'r' || o_orderkey AS review_id,
                     CASE WHEN o_totalprice < 25000 THEN 1 WHEN o_totalprice < 50000 THEN 2
                          WHEN o_totalprice < 200000 THEN 3 WHEN o_totalprice < 350000 THEN 4 ELSE 5 END AS score,
                     o_orderdate + INTERVAL 45 DAY AS created
              FROM orders WHERE o_orderkey % 17 <> 0
              UNION ALL
              SELECT o_orderkey, 'q' || o_orderkey, 5, o_orderdate + INTERVAL 40 DAY
              FROM orders WHERE o_orderkey % 23 = 0)""",
    "m_products": """
        SELECT p_partkey AS product_id, p_type AS category, p_size * 100 AS weight, p_size % 6 AS photos FROM part""",
    "m_sellers": """
        SELECT s_suppkey AS seller_id, n_name AS city, r_name AS state
        FROM supplier, nation, region WHERE s_nationkey = n_nationkey AND n_regionkey = r_regionkey""",
    "m_customers": """
        SELECT c_custkey AS customer_id, n_name AS city, r_name AS state
        FROM customer, nation, region WHERE c_nationkey = n_nationkey AND n_regionkey = r_regionkey""",
    # seller metrics: whole period and per purchase month
    "m_shipped": """
        SELECT i.seller_id, i.order_id, i.price, i.freight, o.order_status, o.purchased,
               CAST(date_trunc('month', o.purchased) AS DATE) AS month, s.city, s.state, o.customer_id,
               CASE WHEN o.order_status = 'delivered' THEN datediff('day', o.promised, o.arrived) END AS delay,
               o.order_status = 'delivered' AND o.arrived > o.promised AS late
        FROM m_items i JOIN m_sellers s USING (seller_id) LEFT JOIN m_orders o USING (order_id)""",
    "m_rated": """
        SELECT i.seller_id, i.product_id, r.order_id, r.score, r.created, r.message,
               CAST(date_trunc('month', o.purchased) AS DATE) AS month,
               datediff('day', r.created, r.answered) AS answer_days
        FROM m_reviews r JOIN m_orders o USING (order_id) JOIN m_items i USING (order_id)""",
}


def share(part: str, whole: str) -> str:
    return f"round({part} * 100.0 / nullif({whole}, 0), 2)"


def exact_sum(value: str, places: int = 6) -> str:
    """A sum that does not depend on the order of addition."""
    return f"CAST(sum(CAST({value} AS DECIMAL(28, {places}))) AS DOUBLE)"


def exact_mean(value: str, places: int = 6) -> str:
    return f"({exact_sum(value, places)} / nullif(count({value}), 0))"


def nearest(value: str, digits: int) -> str:
    """The SQL form of :func:`rounded`."""
    return f"CAST(format('{{:.{digits}f}}', CAST({value} AS DOUBLE)) AS DOUBLE)"


def delivery_sql(keys: str) -> str:
    delivered = "count(DISTINCT order_id) FILTER (order_status = 'delivered')"
    canceled = "count(DISTINCT order_id) FILTER (order_status = 'canceled')"
    return f"""
        SELECT {keys}, count(DISTINCT order_id) AS total_orders, {delivered} AS delivered_orders,
               {canceled} AS canceled_orders, avg(delay) AS avg_delivery_delay_days,
               {share("count(DISTINCT order_id) FILTER (late)", delivered)} AS delay_rate_pct,
               {share(canceled, "count(DISTINCT order_id)")} AS cancel_rate_pct,
               {exact_mean("price")} AS avg_price, {exact_sum("price")} AS total_revenue, max(delay) AS max_delivery_delay_days
        FROM m_shipped GROUP BY {keys}"""


def review_sql(keys: str, source: str = "m_rated") -> str:
    reviewed = "count(DISTINCT order_id)"
    negative = "count(DISTINCT order_id) FILTER (score <= 2)"
    return f"""
        SELECT {keys}, {reviewed} AS reviewed_orders, avg(score) AS avg_review_score,
               {negative} AS negative_reviews, count(DISTINCT order_id) FILTER (score >= 4) AS positive_reviews,
               {share(negative, reviewed)} AS negative_review_rate_pct,
               avg(answer_days) AS avg_review_response_days, min(score) AS worst_review_score
        FROM {source} GROUP BY {keys}"""


def product_sql(period: bool = False, where: str = "true") -> str:
    keys = "p.product_id, p.category, p.weight, p.photos"
    month = ", CAST(date_trunc('month', o.purchased) AS DATE) AS month" if period else ""
    if period:
        keys += ", CAST(date_trunc('month', o.purchased) AS DATE)"
    bad = "count(DISTINCT r.order_id) FILTER (r.score <= 2)"
    return f"""
        SELECT p.product_id, p.category, p.weight, p.photos{month}, count(DISTINCT i.order_id) AS total_orders,
               count(DISTINCT r.order_id) AS reviewed_orders, avg(r.score) AS avg_review_score,
               {bad} AS defect_signals, {share(bad, "count(DISTINCT r.order_id)")} AS defect_rate_pct,
               {exact_mean("i.price")} AS avg_unit_price
        FROM m_items i JOIN m_products p USING (product_id) JOIN m_orders o USING (order_id)
             LEFT JOIN m_reviews r USING (order_id)
        WHERE {where} GROUP BY {keys}"""


def query_sql(body: str, **extra: str) -> str:
    """``body`` after the views it (or an extra view) mentions."""
    needed = body + " ".join(extra.values())
    used: list[str] = []
    for name in reversed(list(VIEWS)):
        if name in needed:
            used.insert(0, name)
            needed += VIEWS[name]
    views = [f"{n} AS ({VIEWS[n]})" for n in used] + [f"{n} AS ({sql})" for n, sql in extra.items()]
    return f"WITH {', '.join(views)} {body}" if views else body
