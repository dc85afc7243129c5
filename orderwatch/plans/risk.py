"""Marts, risk scores, profiles and category risk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import marts, risk
from ..sources.audit import catalog_counts as count_catalog
from ..sources.star import load_star
from .base import clock, delivery_sql, exact_mean, exact_sum, nearest, product_sql, query_sql, review_sql, rounded

WINDOW = ("1997-01-01", "1999-12-31")
HEAVY_DELAY = risk.RiskWeights(delay_rate=0.7, low_review_rate=0.1, cancel_rate=0.1, freight_ratio=0.1)


def orders_enriched(spark: SparkSession, folder: str) -> DataFrame:
    times = (
        "order_purchase_timestamp", "order_approved_at", "order_delivered_carrier_date",
        "order_delivered_customer_date", "order_estimated_delivery_date",
    )
    df = rounded(marts.orders_enriched(load_star(spark, folder)), 6, "total_payment")
    return df.select(*(clock(c) if c in times else c for c in df.columns))


def seller_delivery_metrics(spark: SparkSession, folder: str) -> DataFrame:
    df = rounded(marts.seller_delivery_metrics(load_star(spark, folder)), 6, "avg_delivery_delay_days", "avg_price")
    return rounded(df, 4, "total_revenue")


def state_delay_compare(spark: SparkSession, folder: str) -> DataFrame:
    df = rounded(marts.state_delivery_metrics(load_star(spark, folder)), 6, "avg_delivery_delay_days", "avg_price")
    return rounded(df, 4, "total_revenue")


def review_risk_metrics(spark: SparkSession, folder: str) -> DataFrame:
    df = marts.review_risk_metrics(load_star(spark, folder))
    return rounded(df, 6, "avg_review_score", "avg_review_response_days")


def product_quality_metrics(spark: SparkSession, folder: str) -> DataFrame:
    df = marts.product_quality_metrics(load_star(spark, folder))
    return rounded(df, 6, "avg_review_score", "avg_unit_price")


def freight_ratio(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(marts.freight_ratio(load_star(spark, folder), *WINDOW), 6, "avg_freight_ratio")


def _flat_scores(df: DataFrame) -> DataFrame:
    return df.select(*(c for c in df.columns if c != "risk_breakdown"), "risk_breakdown.*")


def top_risky_sellers(spark: SparkSession, folder: str) -> DataFrame:
    return _flat_scores(risk.top_risky_sellers(load_star(spark, folder), limit=10))


def top_risky_sellers_windowed(spark: SparkSession, folder: str) -> DataFrame:
    tables = load_star(spark, folder)
    return _flat_scores(risk.top_risky_sellers(tables, None, *WINDOW, weights=HEAVY_DELAY, window_scope="all"))


def risky_sellers_at_level(spark: SparkSession, folder: str) -> DataFrame:
    tables = load_star(spark, folder)
    return _flat_scores(risk.top_risky_sellers(tables, 10, *WINDOW, risk_level="P1"))


def order_risk(spark: SparkSession, folder: str) -> DataFrame:
    df = risk.order_risk(load_star(spark, folder))
    times = ("order_purchase_timestamp", "delivered_date", "estimated_date")
    df = df.withColumn("risk_flags", F.array_join("risk_flags", ","))
    return df.select(*(clock(c) if c in times else c for c in df.columns))


def order_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """One order by its key: the first one."""
    df = risk.order_risk(load_star(spark, folder), order_id=1)
    return df.select("order_id", "customer_state", "order_status", "delivery_delay_days", "total_payment", "review_score")


def seller_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """One seller by its key."""
    df = risk.seller_profile(load_star(spark, folder), seller_id=3)
    return df.select("seller_id", "seller_city", "seller_state", "delivery_metrics.*", F.size("recent_orders").alias("n_recent"))


def late_low_review_orders(spark: SparkSession, folder: str) -> DataFrame:
    # a promise is kept within four days at most in this data
    found = risk.late_low_review_orders(load_star(spark, folder), min_delay_days=2)
    return found.select("order_id", "customer_state", "delivery_delay_days", "review_score")


def risky_seller_filter(spark: SparkSession, folder: str) -> DataFrame:
    found = risk.sellers_over(load_star(spark, folder), 12.0, 6.0)
    return found.select("seller_id", "total_orders", "delay_rate_pct", "cancel_rate_pct")


def seller_profile(spark: SparkSession, folder: str) -> DataFrame:
    recent = F.transform(
        "recent_orders",
        lambda o: F.concat_ws(
            ":", o["order_id"].cast("string"), o["order_status"], o["delivery_delay_days"].cast("int").cast("string"),
            F.coalesce(o["review_score"].cast("string"), F.lit("-")),
        ),
    )
    return risk.seller_profile(load_star(spark, folder)).select(
        "seller_id", "seller_city", "seller_state", "delivery_metrics.*", "review_metrics.*",
        F.array_join(recent, ",").alias("recent_orders"),
    )


def category_quality_risk(spark: SparkSession, folder: str) -> DataFrame:
    return risk.category_quality_risk(load_star(spark, folder))


def category_quality_windowed(spark: SparkSession, folder: str) -> DataFrame:
    return risk.category_quality_risk(load_star(spark, folder), "A", *WINDOW)


def catalog_counts(spark: SparkSession, folder: str) -> DataFrame:
    tables = load_star(spark, folder)
    return count_catalog(tables, marts.build_marts(tables))


QUERIES = {
    f.__name__: f
    for f in (
        orders_enriched, seller_delivery_metrics, state_delay_compare, review_risk_metrics, product_quality_metrics,
        freight_ratio, top_risky_sellers, top_risky_sellers_windowed, risky_sellers_at_level, order_risk,
        order_lookup, seller_lookup, late_low_review_orders, risky_seller_filter, seller_profile, category_quality_risk,
        category_quality_windowed, catalog_counts,
    )
}

# ------------------------------------------------------------------ SQL twins

_LATEST = "SELECT order_id, arg_max(score, (created, review_id)) AS review_score FROM m_reviews GROUP BY order_id"
_PAID = f"""SELECT order_id, {exact_sum("paid")} AS total_payment, string_agg(DISTINCT kind, ', ' ORDER BY kind) AS payment_types
           FROM m_payments GROUP BY order_id"""
_IN_WINDOW = f"purchased BETWEEN TIMESTAMP '{WINDOW[0]}' AND TIMESTAMP '{WINDOW[1]}'"
_STATE = """
    SELECT o.*, datediff('day', promised, arrived) AS delay, total_payment, payment_types, review_score
    FROM m_orders o LEFT JOIN paid USING (order_id) LEFT JOIN latest USING (order_id)"""


def _text(column: str, name: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S') AS {name}"


def _delivery(keys: str, columns: str) -> str:
    return query_sql(
        f"""SELECT {columns}, total_orders, delivered_orders, canceled_orders,
                   {nearest("avg_delivery_delay_days", 6)} AS avg_delivery_delay_days, delay_rate_pct, cancel_rate_pct,
                   {nearest("avg_price", 6)} AS avg_price, {nearest("total_revenue", 4)} AS total_revenue FROM d""",
        d=delivery_sql(keys),
    )


def _scores(weights: risk.RiskWeights, window: str, everywhere: bool, tail: str) -> str:
    """Scored sellers; the window limits freight only, or all measures."""
    scope = f"(SELECT * FROM m_shipped WHERE {window})" if everywhere else "m_shipped"
    rated = f"""SELECT * FROM m_rated SEMI JOIN (SELECT order_id FROM m_orders WHERE {window}) USING (order_id)"""
    parts = (
        ("delay_risk", "delay", 30.0, weights.delay_rate),
        ("review_risk", "low", 30.0, weights.low_review_rate),
        ("cancel_risk", "cancel", 20.0, weights.cancel_rate),
        ("freight_risk", "freight", 0.5, weights.freight_ratio),
    )
    breakdown = ", ".join(
        nearest(f"least({c} / CAST({cap} AS DOUBLE), 1.0::DOUBLE) * CAST({w} AS DOUBLE) * 100", 1) + f" AS {name}"
        for name, c, cap, w in parts
    )
    return query_sql(
        f"""SELECT * FROM (SELECT *, CASE WHEN risk_score >= 50 THEN 'P0' WHEN risk_score >= 30 THEN 'P1'
                                 WHEN risk_score >= 15 THEN 'P2' ELSE 'P3' END AS risk_level FROM scored) {tail}""",
        d=delivery_sql("seller_id, city, state").replace("m_shipped", scope),
        rated=rated if everywhere else "SELECT * FROM m_rated",
        r=review_sql("seller_id", "rated"),
        f=f"SELECT seller_id, {exact_mean("freight / nullif(price, 0)", 12)} AS ratio FROM m_shipped WHERE {window} GROUP BY seller_id",
        rates="""SELECT seller_id, city, state, total_orders, coalesce(delay_rate_pct, 0) AS delay,
                        coalesce(cancel_rate_pct, 0) AS cancel, coalesce(negative_review_rate_pct, 0) AS low,
                        coalesce(ratio, 0) AS freight, coalesce(avg_delivery_delay_days, 0) AS days
                 FROM d LEFT JOIN r USING (seller_id) LEFT JOIN f USING (seller_id)""",
        parts=f"SELECT *, {breakdown} FROM rates",
        scored=f"""SELECT seller_id, city AS seller_city, state AS seller_state, total_orders,
                          {nearest("delay", 2)} AS delay_rate_pct, {nearest("cancel", 2)} AS cancel_rate_pct,
                          {nearest("low", 2)} AS low_review_rate_pct, {nearest("freight", 4)} AS avg_freight_ratio,
                          {nearest("days", 2)} AS avg_delivery_delay_days, delay_risk, review_risk, cancel_risk,
                          freight_risk,
                          {nearest("delay_risk + review_risk + cancel_risk + freight_risk", 1)} AS risk_score
                   FROM parts""",
    )


_RANK = "ORDER BY risk_score DESC, total_orders DESC, seller_id"


def _category(where: str) -> str:
    zero = lambda e: nearest(f"coalesce({e}, 0)", 2)
    rate = zero("round(sum(defect_signals) * 100.0 / nullif(sum(reviewed_orders), 0), 2)")
    return query_sql(
        f"""SELECT category AS product_category_name, count(*) AS product_count,
                   CAST(sum(total_orders) AS BIGINT) AS total_orders, CAST(sum(defect_signals) AS BIGINT) AS total_defects,
                   {zero(exact_mean("avg_review_score", 12))} AS category_avg_score, {rate} AS defect_rate_pct,
                   {zero(exact_mean("avg_unit_price", 12))} AS avg_price,
                   CASE WHEN {rate} >= 40 THEN 'P0' WHEN {rate} >= 20 THEN 'P1' WHEN {rate} >= 10 THEN 'P2'
                        ELSE 'P3' END AS risk_level
            FROM q GROUP BY category""",
        q=product_sql(where=where),
    )


def _profile() -> str:
    zeros = ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("total_orders", "delivered_orders", "canceled_orders"))
    counts = ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("reviewed_orders", "negative_reviews", "positive_reviews"))
    shown = ", ".join(
        f"{nearest(f'coalesce({c}, 0)', 2)} AS {c}"
        for c in (
            "avg_delivery_delay_days", "delay_rate_pct", "cancel_rate_pct", "avg_price", "total_revenue",
            "avg_review_score", "negative_review_rate_pct", "avg_review_response_days",
        )
    )
    return query_sql(
        f"""SELECT s.seller_id, s.city AS seller_city, s.state AS seller_state, {zeros}, {counts}, {shown},
                   nullif(worst_review_score, 0) AS worst_review_score, coalesce(recent, '') AS recent_orders
            FROM m_sellers s LEFT JOIN d USING (seller_id) LEFT JOIN r USING (seller_id) LEFT JOIN n USING (seller_id)""",
        latest=_LATEST,
        d=delivery_sql("seller_id"),
        r=review_sql("seller_id"),
        n="""SELECT seller_id, string_agg(concat(order_id, ':', order_status, ':', coalesce(delay, 0), ':',
                           coalesce(CAST(review_score AS VARCHAR), '-')), ',' ORDER BY place) AS recent
             FROM (SELECT seller_id, order_id, order_status, datediff('day', promised, arrived) AS delay, review_score,
                          row_number() OVER (PARTITION BY seller_id ORDER BY purchased DESC, order_id DESC) AS place
                   FROM (SELECT DISTINCT seller_id, order_id FROM m_items) JOIN m_orders USING (order_id)
                        LEFT JOIN latest USING (order_id))
             WHERE place <= 10 GROUP BY seller_id""",
    )


ORACLES = {
    "orders_enriched": query_sql(
        f"""SELECT order_id, o.customer_id, c.city AS customer_city, c.state AS customer_state, order_status,
                   {_text("purchased", "order_purchase_timestamp")}, {_text("purchased", "order_approved_at")},
                   {_text("arrived", "order_delivered_carrier_date")},
                   {_text("arrived", "order_delivered_customer_date")},
                   {_text("promised", "order_estimated_delivery_date")}, delay AS delivery_delay_days,
                   {nearest("total_payment", 6)} AS total_payment, payment_types, review_score
            FROM s o LEFT JOIN m_customers c USING (customer_id)""",
        paid=_PAID, latest=_LATEST, s=_STATE,
    ),
    "seller_delivery_metrics": _delivery(
        "seller_id, city, state", "seller_id, city AS seller_city, state AS seller_state"
    ),
    "state_delay_compare": _delivery("state", "state AS seller_state"),
    "review_risk_metrics": query_sql(
        f"""SELECT seller_id, reviewed_orders, {nearest("avg_review_score", 6)} AS avg_review_score, negative_reviews,
                  positive_reviews, negative_review_rate_pct,
                  {nearest("avg_review_response_days", 6)} AS avg_review_response_days, worst_review_score FROM r""",
        r=review_sql("seller_id"),
    ),
    "product_quality_metrics": query_sql(
        f"""SELECT product_id, category AS product_category_name, total_orders, reviewed_orders,
                  {nearest("avg_review_score", 6)} AS avg_review_score, defect_signals, defect_rate_pct,
                  {nearest("avg_unit_price", 6)} AS avg_unit_price, CAST(weight AS DOUBLE) AS weight_g, photos AS photos_qty
           FROM q""",
        q=product_sql(),
    ),
    "freight_ratio": query_sql(
        f"""SELECT seller_id, {nearest(exact_mean("freight / nullif(price, 0)", 12), 6)} AS avg_freight_ratio
            FROM m_items JOIN m_orders USING (order_id) WHERE {_IN_WINDOW} GROUP BY seller_id"""
    ),
    "top_risky_sellers": _scores(risk.RiskWeights(), "true", False, f"{_RANK} LIMIT 10"),
    "top_risky_sellers_windowed": _scores(HEAVY_DELAY, _IN_WINDOW, True, ""),
    "risky_sellers_at_level": _scores(
        risk.RiskWeights(), _IN_WINDOW, False, f"WHERE risk_level = 'P1' {_RANK} LIMIT 10"
    ),
    "order_risk": query_sql(
        f"""SELECT order_id, o.customer_id, c.city AS customer_city, c.state AS customer_state, order_status,
                   {_text("purchased", "order_purchase_timestamp")}, {_text("arrived", "delivered_date")},
                   {_text("promised", "estimated_date")}, CAST(coalesce(delay, 0) AS DOUBLE) AS delivery_delay_days,
                   {nearest("coalesce(total_payment, 0)", 2)} AS total_payment, payment_types, review_score,
                   coalesce(delay, 0) > 0 AS is_delayed, coalesce(review_score BETWEEN 1 AND 2, false) AS is_low_review,
                   concat_ws(',', CASE WHEN order_status = 'canceled' THEN 'canceled' END,
                             CASE WHEN delay > 3 THEN 'significant_delay' WHEN delay > 0 THEN 'minor_delay' END,
                             CASE WHEN review_score <= 2 THEN 'low_review' END,
                             CASE WHEN review_score IS NULL AND order_status = 'delivered' THEN 'missing_review' END
                            ) AS risk_flags
            FROM s o LEFT JOIN m_customers c USING (customer_id)""",
        paid=_PAID, latest=_LATEST, s=_STATE,
    ),
    "order_lookup": query_sql(
        f"""SELECT order_id, c.state AS customer_state, order_status, CAST(coalesce(delay, 0) AS DOUBLE) AS delivery_delay_days,
                   {nearest("coalesce(total_payment, 0)", 2)} AS total_payment, review_score
            FROM s LEFT JOIN m_customers c USING (customer_id) WHERE order_id = 1""",
        paid=_PAID, latest=_LATEST, s=_STATE,
    ),
    "seller_lookup": query_sql(
        f"""SELECT seller_id, city AS seller_city, state AS seller_state, total_orders, delivered_orders, canceled_orders,
                   {", ".join(f"{nearest(f'coalesce({c}, 0)', 2)} AS {c}" for c in ("avg_delivery_delay_days", "delay_rate_pct", "cancel_rate_pct", "avg_price", "total_revenue"))},
                   least(total_orders, 10) AS n_recent FROM d WHERE seller_id = 3""",
        d=delivery_sql("seller_id, city, state"),
    ),
    "late_low_review_orders": query_sql(
        """SELECT order_id, c.state AS customer_state, delay AS delivery_delay_days, review_score
           FROM s LEFT JOIN m_customers c USING (customer_id) WHERE delay > 2 AND review_score <= 2""",
        paid=_PAID, latest=_LATEST, s=_STATE,
    ),
    "risky_seller_filter": query_sql(
        """SELECT seller_id, total_orders, delay_rate_pct, cancel_rate_pct FROM d
           WHERE delay_rate_pct > 12 AND cancel_rate_pct > 6""",
        d=delivery_sql("seller_id"),
    ),
    "seller_profile": _profile(),
    "category_quality_risk": _category("true"),
    "category_quality_windowed": _category(f"contains(category, 'A') AND {_IN_WINDOW}"),
    "catalog_counts": query_sql(
        " UNION ALL ".join(
            f"SELECT '{name}' AS name, '{kind}' AS kind, count(*) AS n_rows FROM {source}"
            for name, kind, source in (
                ("orders", "table", "m_orders"), ("order_items", "table", "m_items"),
                ("order_payments", "table", "m_payments"), ("order_reviews", "table", "m_reviews"),
                ("products", "table", "m_products"), ("sellers", "table", "m_sellers"),
                ("customers", "table", "m_customers"), ("orders_enriched", "mart", "m_orders"),
                ("seller_delivery_metrics", "mart", "(SELECT DISTINCT seller_id FROM m_shipped)"),
                ("review_risk_metrics", "mart", "(SELECT DISTINCT seller_id FROM m_rated)"),
                ("product_quality_metrics", "mart", "(SELECT DISTINCT product_id FROM m_items SEMI JOIN m_products USING (product_id))"),
            )
        )
    ),
}
