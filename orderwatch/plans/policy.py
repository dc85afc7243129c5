"""Operational tiers, triage, trends, automatic tasks and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import marts, policy, tasks
from ..sources.star import load_star
from .base import delivery_sql, nearest, product_sql, query_sql, review_sql, rounded, share

AS_OF = "1999-06-30"
MIN_SAMPLE = 540


def seller_months(spark: SparkSession, folder: str) -> DataFrame:
    return marts.seller_scorecard(load_star(spark, folder), period="month")


def product_months(spark: SparkSession, folder: str) -> DataFrame:
    return marts.product_quality_metrics(load_star(spark, folder), period="month")


def candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Task candidates of every seller and product month."""
    sellers = policy.auto_tasks(seller_months(spark, folder), "seller", "seller_id", "period")
    products = policy.auto_tasks(product_months(spark, folder), "product", "product_id", "period")
    return sellers.unionByName(products)


def delivery_tier(spark: SparkSession, folder: str) -> DataFrame:
    rows = seller_months(spark, folder).withColumn("delivery_tier", policy.delivery_tier())
    rows = policy.guard_small_sample(rows, "delivery_tier", "total_orders", 5)
    return rows.select("seller_id", "period", "delay_rate_pct", "max_delivery_delay_days", "delivery_tier", "sample_note")


def review_tier(spark: SparkSession, folder: str) -> DataFrame:
    rows = policy.seller_review_tiers(load_star(spark, folder), MIN_SAMPLE)
    return rows.select("seller_id", "reviewed_orders", "n_unsafe_products", "review_tier", "sample_note")


def product_tier_price_band(spark: SparkSession, folder: str) -> DataFrame:
    rows = policy.product_tiers(load_star(spark, folder))
    return rows.select("product_id", "defect_rate_pct", "price_band", "n_unsafe", "product_tier")


def review_triage(spark: SparkSession, folder: str) -> DataFrame:
    rows = policy.triage_reviews(load_star(spark, folder)["order_reviews"])
    return rows.select("review_id", "order_id", F.array_join("matched", ",").alias("matched"), "category", "owner")


def seller_week_trend(spark: SparkSession, folder: str) -> DataFrame:
    return policy.seller_week_trend(load_star(spark, folder))


def category_week_trend(spark: SparkSession, folder: str) -> DataFrame:
    return policy.category_week_trend(load_star(spark, folder), rising_weeks=3)


def category_four_week_trend(spark: SparkSession, folder: str) -> DataFrame:
    """With the number of weeks that the procedure names."""
    return policy.category_week_trend(load_star(spark, folder))


def auto_tasks(spark: SparkSession, folder: str) -> DataFrame:
    return candidates(spark, folder)


def task_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = tasks.deduplicate(candidates(spark, folder))
    return kept.select(
        "target_kind", "target_id", "cycle", "task_type", "priority", "title", "n_candidates",
        F.array_join("sub_items", ",").alias("sub_items"),
    )


def rule_trigger_share(spark: SparkSession, folder: str) -> DataFrame:
    sellers = policy.rule_trigger_share(seller_months(spark, folder))
    return sellers.unionByName(policy.rule_trigger_share(product_months(spark, folder)))


def region_evidence(spark: SparkSession, folder: str) -> DataFrame:
    tables = load_star(spark, folder)
    tiers = marts.seller_scorecard(tables).withColumn("tier", policy.delivery_tier())
    risky = tiers.filter(F.col("tier").isin("P0", "P1")).select("seller_id")
    return rounded(policy.region_evidence(tables, risky, AS_OF), 6, "avg_delay_days")


QUERIES = {
    f.__name__: f
    for f in (
        delivery_tier, review_tier, product_tier_price_band, review_triage, seller_week_trend, category_week_trend, category_four_week_trend,
        auto_tasks, task_dedup, rule_trigger_share, region_evidence,
    )
}

# ------------------------------------------------------------------ SQL twins

_TIER = """CASE WHEN delay_rate_pct > 30 OR max_delivery_delay_days > 15 THEN 'P0'
                WHEN delay_rate_pct BETWEEN 15 AND 30 OR avg_delivery_delay_days > 7 THEN 'P1'
                WHEN delay_rate_pct >= 5 OR avg_delivery_delay_days >= 3 THEN 'P2' ELSE 'P3' END"""
_UNSAFE = """SELECT order_id, count(*) AS n FROM m_reviews
             WHERE score <= 2 AND (contains(message, 'leaking') OR contains(message, '漏液')) GROUP BY order_id"""

SELLER_MONTHS = """
    SELECT d.*, reviewed_orders, avg_review_score, coalesce(negative_reviews, 0) AS negative_reviews,
           negative_review_rate_pct
    FROM d LEFT JOIN r USING (seller_id, month)"""

_FIRES = """
    SELECT 'seller' AS target_kind, CAST(seller_id AS VARCHAR) AS target_id, month AS cycle, 'delivery_risk' AS task_type,
           CASE WHEN delay_rate_pct > 30 THEN 'P0' ELSE 'P1' END AS priority,
           CASE WHEN delay_rate_pct > 30 THEN '区域经理' ELSE '运营专员' END AS assignee, 'delay_rate_pct' AS metric,
           delay_rate_pct AS value, format('[物流风险] {} 延迟率 {:.2f}%', seller_id, delay_rate_pct) AS title,
           format('卖家: {} ({}, {})', seller_id, city, state) || chr(10) || format('延迟率: {:.2f}%', delay_rate_pct)
               || chr(10) || format('平均延迟: {:.2f} 天', coalesce(avg_delivery_delay_days, 0)) || chr(10)
               || format('总订单: {}', total_orders) AS description, 'SOP-DELIVERY-001 §1.2' AS sop_reference
    FROM seller_months WHERE delay_rate_pct >= 15
    UNION ALL
    SELECT 'seller', CAST(seller_id AS VARCHAR), month, 'review_triage',
           CASE WHEN negative_review_rate_pct > 50 THEN 'P0' ELSE 'P1' END,
           CASE WHEN negative_review_rate_pct > 50 THEN '客服主管' ELSE '客服专员' END, 'negative_review_rate_pct',
           negative_review_rate_pct, format('[差评风险] {} 差评率 {:.2f}%', seller_id, negative_review_rate_pct),
           format('卖家: {}', seller_id) || chr(10) || format('差评率: {:.2f}%', negative_review_rate_pct) || chr(10)
               || format('平均评分: {:.2f}', coalesce(avg_review_score, 0)) || chr(10)
               || format('差评总数: {}', negative_reviews), 'SOP-REVIEW-002 §1.2'
    FROM seller_months WHERE negative_review_rate_pct >= 30
    UNION ALL
    SELECT 'product', CAST(product_id AS VARCHAR), month, 'quality_inspection',
           CASE WHEN defect_rate_pct > 40 THEN 'P0' ELSE 'P1' END,
           CASE WHEN defect_rate_pct > 40 THEN '品控主管' ELSE '品控专员' END, 'defect_rate_pct', defect_rate_pct,
           format('[质量风险] {} 缺陷率 {:.2f}%', product_id, defect_rate_pct),
           format('商品: {} ({})', product_id, category) || chr(10) || format('缺陷率: {:.2f}%', defect_rate_pct)
               || chr(10) || format('平均评分: {:.2f}', coalesce(avg_review_score, 0)) || chr(10)
               || format('平均单价: R$ {:.2f}', coalesce(avg_unit_price, 0)), 'SOP-PRODUCT-003 §1.2'
    FROM product_months WHERE defect_rate_pct >= 20"""

# views behind the automatic tasks, shared with the task queries
TASK_VIEWS = {
    "d": delivery_sql("seller_id, city, state, month"),
    "r": review_sql("seller_id, month"),
    "seller_months": SELLER_MONTHS,
    "product_months": product_sql(period=True),
    "fired": _FIRES,
}


def _rising(key: str, steps: int) -> str:
    order = f"(PARTITION BY {key} ORDER BY period)"
    rate = "negative_review_rate_pct"
    rises = " AND ".join(
        f"{f'lag({rate}, {i}) OVER {order}' if i else rate} > lag({rate}, {i + 1}) OVER {order}" for i in range(steps)
    )
    return f"coalesce(lag(period, {steps}) OVER {order} = period - {7 * steps} AND {rises}, false)"


def _weekly(key: str, columns: str, source: str) -> str:
    weekly = review_sql(f"{key}, CAST(date_trunc('week', created) AS DATE)", source)
    weekly = weekly.replace("CAST(date_trunc('week', created) AS DATE),", "CAST(date_trunc('week', created) AS DATE) AS period,", 1)
    return query_sql(
        f"SELECT {columns}, period, reviewed_orders, negative_reviews, negative_review_rate_pct, {{alerts}} FROM w", w=weekly
    )


_RULES = (
    ("delay_rate_pct", "P0", "delay_rate_pct > 30", "seller_months"),
    ("negative_review_rate_pct", "P0", "negative_review_rate_pct > 50", "seller_months"),
    ("delay_rate_pct", "P1", "delay_rate_pct BETWEEN 15 AND 30", "seller_months"),
    ("negative_review_rate_pct", "P1", "negative_review_rate_pct BETWEEN 30 AND 50", "seller_months"),
    ("defect_rate_pct", "P0", "defect_rate_pct > 40", "product_months"),
    ("defect_rate_pct", "P1", "defect_rate_pct BETWEEN 20 AND 40", "product_months"),
)

ORACLES = {
    "delivery_tier": query_sql(
        f"""SELECT seller_id, month AS period, delay_rate_pct, max_delivery_delay_days,
                   CASE WHEN total_orders < 5 THEN 'P3' ELSE {_TIER} END AS delivery_tier,
                   CASE WHEN total_orders < 5 THEN 'insufficient sample' END AS sample_note FROM d""",
        d=delivery_sql("seller_id, month"),
    ),
    "review_tier": query_sql(
        f"""SELECT seller_id, reviewed_orders, coalesce(n, 0) AS n_unsafe_products,
                   CASE WHEN reviewed_orders < {MIN_SAMPLE} THEN 'P3'
                        WHEN negative_review_rate_pct > 50 OR n > 0 THEN 'P0'
                        WHEN negative_review_rate_pct >= 30 OR avg_review_score < 2.5 THEN 'P1'
                        WHEN negative_review_rate_pct >= 10 THEN 'P2' ELSE 'P3' END AS review_tier,
                   CASE WHEN reviewed_orders < {MIN_SAMPLE} THEN 'insufficient sample' END AS sample_note
            FROM r LEFT JOIN u USING (seller_id)""",
        r=review_sql("seller_id"),
        unsafe=_UNSAFE,
        u="""SELECT seller_id, count(*) AS n FROM (
                 SELECT seller_id, product_id FROM (SELECT DISTINCT order_id, product_id, seller_id FROM m_items)
                 JOIN unsafe USING (order_id) GROUP BY ALL HAVING sum(n) >= 5) GROUP BY seller_id""",
    ),
    "product_tier_price_band": query_sql(
        """SELECT product_id, defect_rate_pct, price_band, CAST(coalesce(n, 0) AS BIGINT) AS n_unsafe,
                  CASE WHEN defect_rate_pct > urgent OR n > 0 THEN 'P0' WHEN defect_rate_pct > important THEN 'P1'
                       WHEN defect_rate_pct >= 10 THEN 'P2' ELSE 'P3' END AS product_tier
           FROM q JOIN bands ON avg_unit_price >= low AND avg_unit_price < high LEFT JOIN u USING (product_id)""",
        q=product_sql(),
        bands="""SELECT * FROM (VALUES ('<100', 0, 100, 40, 20), ('100-500', 100, 500.0000001, 30, 15),
                                       ('>500', 500.0000001, 1e12, 20, 10)) AS t(price_band, low, high, urgent, important)""",
        unsafe=_UNSAFE,
        u="""SELECT product_id, sum(n) AS n FROM (SELECT DISTINCT order_id, product_id FROM m_items)
             JOIN unsafe USING (order_id) GROUP BY product_id""",
    ),
    "review_triage": query_sql(
        """SELECT review_id, order_id,
                  CASE WHEN contains(message, 'slow') THEN 'logistics' WHEN contains(message, 'broken') THEN 'quality'
                       WHEN contains(message, 'rude') THEN 'service' WHEN contains(message, 'not worth') THEN 'price'
                       ELSE '' END AS matched,
                  CASE matched WHEN '' THEN 'other' ELSE matched END AS category,
                  CASE matched WHEN 'logistics' THEN 'carrier / seller' WHEN 'quality' THEN 'seller / quality control'
                               WHEN 'service' THEN 'seller service' WHEN 'price' THEN 'pricing' END AS owner
           FROM m_reviews WHERE score <= 2"""
    ),
    "seller_week_trend": _weekly("seller_id", "seller_id", "m_rated").replace(
        "{alerts}", f"{_rising('seller_id', 2)} AS rising_alert, negative_reviews >= 3 AS manual_review"
    ),
    "category_week_trend": _weekly(
        "category", "category AS product_category_name", "m_rated JOIN m_products USING (product_id)"
    ).replace(
        "{alerts}",
        f"coalesce(negative_review_rate_pct > 20, false) AS inspection_alert, {_rising('category', 3)} AS strategy_alert",
    ),
    "category_four_week_trend": _weekly(
        "category", "category AS product_category_name", "m_rated JOIN m_products USING (product_id)"
    ).replace(
        "{alerts}",
        f"coalesce(negative_review_rate_pct > 20, false) AS inspection_alert, {_rising('category', 4)} AS strategy_alert",
    ),
    "auto_tasks": query_sql("SELECT * FROM fired", **TASK_VIEWS),
    "task_dedup": query_sql(
        """SELECT target_kind, target_id, cycle, arg_min(task_type, k) AS task_type, min(priority) AS priority,
                  arg_min(title, k) AS title, count(*) AS n_candidates,
                  coalesce(string_agg(k, ',' ORDER BY k) FILTER (place > 1), '') AS sub_items
           FROM (SELECT *, priority || ':' || task_type AS k,
                        row_number() OVER (PARTITION BY target_kind, target_id, cycle ORDER BY priority, task_type) AS place
                 FROM fired) GROUP BY target_kind, target_id, cycle""",
        **TASK_VIEWS,
    ),
    "rule_trigger_share": query_sql(
        "SELECT *, CASE WHEN share_pct > 20 THEN 'too sensitive' WHEN share_pct < 1 THEN 'too loose' ELSE 'ok' END AS verdict FROM ("
        + " UNION ALL ".join(
            f"""SELECT '{metric}' AS metric, '{level}' AS priority, count(*) AS n_rows,
                       count(*) FILTER ({rule}) AS n_fired, {share(f"count(*) FILTER ({rule})", "count(*)")} AS share_pct
                FROM {source}"""
            for metric, level, rule, source in _RULES
        )
        + ")",
        **{k: v for k, v in TASK_VIEWS.items() if k != "fired"},
    ),
    "region_evidence": query_sql(
        f"""SELECT *, {share("n_orders", "sum(n_orders) OVER (PARTITION BY seller_id)")} AS share_pct
            FROM (SELECT seller_id, c.state AS customer_state, count(*) AS n_orders, count(*) FILTER (late) AS n_late,
                         {nearest("avg(delay)", 6)} AS avg_delay_days
                  FROM (SELECT DISTINCT seller_id, order_id, customer_id, late, delay FROM m_shipped
                        WHERE purchased > TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY AND purchased <= TIMESTAMP '{AS_OF}') t
                       JOIN d USING (seller_id) LEFT JOIN m_customers c USING (customer_id)
                  WHERE {_TIER} IN ('P0', 'P1') GROUP BY seller_id, c.state)""",
        d=delivery_sql("seller_id"),
    ),
}
