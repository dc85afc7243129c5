"""Operational rules of the procedure documents, applied to mart rows.

Rules are small tuples turned into column expressions, so no rule needs a join
and none depends on a broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import as_int, half_even, percent
from .marts import Tables, items_per_order, order_outcomes, product_quality_metrics, review_risk_metrics
from .risk import category_week_reviews

# Words in a review that point to a safety problem.
SAFETY_WORDS = ("破损", "漏液", "电击", "冒烟", "过敏", "leaking", "electric shock", "smoke", "allergic")

# Category, words that select it (first matching category wins), owner.
TRIAGE_WORDS = (
    ("logistics", ("慢", "延迟", "破损", "包装差", "slow", "delayed", "bad packaging"), "carrier / seller"),
    ("quality", ("坏", "故障", "与描述不符", "假货", "broken", "defective", "fake"), "seller / quality control"),
    ("service", ("态度差", "不回复", "拒绝退款", "rude", "no reply", "refund refused"), "seller service"),
    ("price", ("贵", "不值", "降价", "overpriced", "not worth", "price drop"), "pricing"),
)

# Lower price of the band, P0 and P1 defect percentages.
PRICE_BANDS = ((500.0, 20, 10), (100.0, 30, 15), (0.0, 40, 20))


@dataclass(frozen=True)
class TaskRule:
    """Creates a task when a metric lies above ``above`` (to ``upto``, inclusive)."""

    metric: str
    above: float
    upto: float | None
    task_type: str
    priority: str
    assignee: str

    def fires(self, value: Column) -> Column:
        if self.upto is None:
            return value > self.above
        return (value >= self.above) & (value <= self.upto)


# Thresholds and owners of automatic tasks.
TASK_RULES = (
    TaskRule("delay_rate_pct", 30, None, "delivery_risk", "P0", "区域经理"),
    TaskRule("negative_review_rate_pct", 50, None, "review_triage", "P0", "客服主管"),
    TaskRule("defect_rate_pct", 40, None, "quality_inspection", "P0", "品控主管"),
    TaskRule("delay_rate_pct", 15, 30, "delivery_risk", "P1", "运营专员"),
    TaskRule("negative_review_rate_pct", 30, 50, "review_triage", "P1", "客服专员"),
    TaskRule("defect_rate_pct", 20, 40, "quality_inspection", "P1", "品控专员"),
)

# Title, body lines and procedure reference per task type.
TASK_TEXTS = {
    "delivery_risk": (
        "[物流风险] {seller_id} 延迟率 {delay_rate_pct}%",
        (
            "卖家: {seller_id} ({seller_city}, {seller_state})",
            "延迟率: {delay_rate_pct}%",
            "平均延迟: {avg_delivery_delay_days} 天",
            "总订单: {total_orders}",
        ),
        "SOP-DELIVERY-001 §1.2",
    ),
    "review_triage": (
        "[差评风险] {seller_id} 差评率 {negative_review_rate_pct}%",
        (
            "卖家: {seller_id}",
            "差评率: {negative_review_rate_pct}%",
            "平均评分: {avg_review_score}",
            "差评总数: {negative_reviews}",
        ),
        "SOP-REVIEW-002 §1.2",
    ),
    "quality_inspection": (
        "[质量风险] {product_id} 缺陷率 {defect_rate_pct}%",
        (
            "商品: {product_id} ({product_category_name})",
            "缺陷率: {defect_rate_pct}%",
            "平均评分: {avg_review_score}",
            "平均单价: R$ {avg_unit_price}",
        ),
        "SOP-PRODUCT-003 §1.2",
    ),
}


def any_word(text: Column, words: Iterable[str]) -> Column:
    """Whether the text contains one of the words (case ignored)."""
    return F.lower(text).rlike("|".join(re.escape(w.lower()) for w in words))


# ------------------------------------------------------------------- tiers


def delivery_tier() -> Column:
    """Level from the delay rate, the mean delay and the worst single delay."""
    rate, mean = F.col("delay_rate_pct"), F.col("avg_delivery_delay_days")
    worst = F.col("max_delivery_delay_days")
    return (
        F.when((rate > 30) | (worst > 15), "P0")
        .when((rate >= 15) | (mean > 7), "P1")
        .when((rate >= 5) | (mean >= 3), "P2")
        .otherwise("P3")
    )


def review_tier(unsafe: Column | None = None) -> Column:
    """Level from the negative-review rate and the mean score."""
    rate, score = F.col("negative_review_rate_pct"), F.col("avg_review_score")
    unsafe = F.lit(False) if unsafe is None else unsafe
    return (
        F.when((rate > 50) | unsafe, "P0")
        .when((rate >= 30) | (score < 2.5), "P1")
        .when(rate >= 10, "P2")
        .otherwise("P3")
    )


def product_tier(unsafe: Column | None = None) -> Column:
    """Level from the defect rate, stricter for expensive products."""
    price, rate = F.coalesce("avg_unit_price", F.lit(0.0)), F.col("defect_rate_pct")
    unsafe = F.lit(False) if unsafe is None else unsafe
    urgent, important = F.lit(False), F.lit(False)
    for lower, first, second in reversed(PRICE_BANDS):
        # above 500, from 100 to 500, below 100
        inside = price > lower if lower == PRICE_BANDS[0][0] else price >= lower
        urgent = F.when(inside, rate > first).otherwise(urgent)
        important = F.when(inside, rate > second).otherwise(important)
    return F.when(urgent | unsafe, "P0").when(important, "P1").when(rate >= 10, "P2").otherwise("P3")


def price_band() -> Column:
    price = F.coalesce("avg_unit_price", F.lit(0.0))
    return F.when(price > 500, ">500").when(price >= 100, "100-500").otherwise("<100")


def guard_small_sample(df: DataFrame, level: str, size: str, min_size: int) -> DataFrame:
    """Lower the level of rows with too few cases to P3 and say so."""
    small = F.coalesce(F.col(size), F.lit(0)) < min_size
    return df.withColumn("sample_note", F.when(small, "insufficient sample")).withColumn(
        level, F.when(small, "P3").otherwise(F.col(level))
    )


# ----------------------------------------------------------------- reviews


def unsafe_reviews_per_order(reviews: DataFrame) -> DataFrame:
    """Number of negative reviews with a safety word, per order that has any."""
    bad = (as_int("review_score") <= 2) & any_word(F.col("review_comment_message"), SAFETY_WORDS)
    return reviews.filter(bad).groupBy("order_id").agg(F.count(F.lit(1)).alias("n_unsafe"))


def unsafe_sellers(tables: Tables, min_reviews: int = 5) -> DataFrame:
    """Sellers with a product that drew many negative safety reviews."""
    lines = tables["order_items"].groupBy("order_id", "product_id", "seller_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        lines.join(unsafe_reviews_per_order(tables["order_reviews"]), "order_id")
        .groupBy("seller_id", "product_id")
        .agg(F.sum("n_unsafe").alias("n_unsafe"))
        .filter(F.col("n_unsafe") >= min_reviews)
        .groupBy("seller_id")
        .agg(F.count(F.lit(1)).alias("n_unsafe_products"))
    )


def unsafe_products(tables: Tables) -> DataFrame:
    """Products with at least one negative safety review."""
    lines = tables["order_items"].groupBy("order_id", "product_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        lines.join(unsafe_reviews_per_order(tables["order_reviews"]), "order_id")
        .groupBy("product_id")
        .agg(F.sum("n_unsafe").alias("n_unsafe"))
    )


def seller_review_tiers(tables: Tables, min_sample: int = 0) -> DataFrame:
    """Review level per seller with the safety rule and the sample guard."""
    flagged = unsafe_sellers(tables)
    rows = review_risk_metrics(tables).join(flagged, "seller_id", "left")
    rows = rows.withColumn("n_unsafe_products", F.coalesce("n_unsafe_products", F.lit(0)))
    rows = rows.withColumn("review_tier", review_tier(F.col("n_unsafe_products") > 0))
    return guard_small_sample(rows, "review_tier", "reviewed_orders", min_sample)


def product_tiers(tables: Tables) -> DataFrame:
    """Quality level per product by price band, with the safety rule."""
    rows = product_quality_metrics(tables).join(unsafe_products(tables), "product_id", "left")
    rows = rows.withColumn("n_unsafe", F.coalesce("n_unsafe", F.lit(0)))
    return rows.withColumns({"price_band": price_band(), "product_tier": product_tier(F.col("n_unsafe") > 0)})


def triage_reviews(reviews: DataFrame) -> DataFrame:
    """Category and owner of each negative review, by words in its text."""
    text = F.coalesce(F.col("review_comment_message"), F.lit(""))
    names, owner = [], F.lit(None).cast("string")
    for name, words, _ in TRIAGE_WORDS:
        names.append(F.when(any_word(text, words), name))
    for name, _, who in TRIAGE_WORDS:
        owner = F.when(F.col("category") == name, who).otherwise(owner)
    return (
        reviews.filter(as_int("review_score") <= 2)
        .withColumn("matched", F.array_compact(F.array(*names)))
        .withColumn("category", F.coalesce(F.get("matched", F.lit(0)), F.lit("other")))
        .withColumn("owner", owner)
    )


# ------------------------------------------------------------------ trends


def _rising(rate: Column, key: str, steps: int) -> Column:
    """Whether the weekly rate rose ``steps`` times over consecutive weeks.

    The window holds one row per week of one key: its size is bounded by the
    calendar, not by the data.
    """
    order = Window.partitionBy(key).orderBy("period")
    rising = F.lag("period", steps).over(order) == F.date_sub("period", 7 * steps)
    for step in range(steps):
        later = rate if step == 0 else F.lag(rate, step).over(order)
        rising = rising & (later > F.lag(rate, step + 1).over(order))
    return F.coalesce(rising, F.lit(False))


def seller_week_trend(tables: Tables, rising_weeks: int = 2, many: int = 3) -> DataFrame:
    """Weekly review rate per seller with the rising and the volume alert."""
    rate = F.col("negative_review_rate_pct")
    weekly = review_risk_metrics(tables, period="week")
    return weekly.select(
        "seller_id",
        "period",
        "reviewed_orders",
        "negative_reviews",
        "negative_review_rate_pct",
        _rising(rate, "seller_id", rising_weeks).alias("rising_alert"),
        (F.col("negative_reviews") >= many).alias("manual_review"),
    )


def category_week_trend(tables: Tables, max_rate: float = 20.0, rising_weeks: int = 4) -> DataFrame:
    """Weekly review rate per category with the level and the rising alert."""
    rate = F.col("negative_review_rate_pct")
    return category_week_reviews(tables).select(
        "product_category_name",
        "period",
        "reviewed_orders",
        "negative_reviews",
        "negative_review_rate_pct",
        F.coalesce(rate > max_rate, F.lit(False)).alias("inspection_alert"),
        _rising(rate, "product_category_name", rising_weeks).alias("strategy_alert"),
    )


# ------------------------------------------------------------ automatic tasks


def _shown(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit("-")
    kind = df.schema[name].dataType.typeName()
    value = F.col(name)
    if kind == "double":
        value = F.regexp_replace(F.format_number(F.coalesce(value, F.lit(0.0)), 2), ",", "")
    return F.coalesce(value.cast("string"), F.lit("-"))


def fill_template(df: DataFrame, template: str) -> Column:
    """Text with ``{column}`` places replaced by the row's values."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(_shown(df, p) if i % 2 else F.lit(p) for i, p in enumerate(parts)))


def auto_tasks(
    rows: DataFrame, target_kind: str, target: str, cycle: str | None = None, rules: Iterable[TaskRule] = TASK_RULES
) -> DataFrame:
    """One task candidate per rule that fires on a metric row.

    Rules whose metric the rows do not have are ignored.
    """
    candidates = []
    for rule in rules:
        if rule.metric not in rows.columns:
            continue
        title, body, reference = TASK_TEXTS[rule.task_type]
        text = F.concat_ws("\n", *(fill_template(rows, line) for line in body))
        candidate = F.struct(
            F.lit(rule.task_type).alias("task_type"),
            F.lit(rule.priority).alias("priority"),
            F.lit(rule.assignee).alias("assignee"),
            F.lit(rule.metric).alias("metric"),
            F.col(rule.metric).alias("value"),
            fill_template(rows, title).alias("title"),
            text.alias("description"),
            F.lit(reference).alias("sop_reference"),
        )
        candidates.append(F.when(rule.fires(F.col(rule.metric)), candidate))
    if not candidates:
        raise ValueError("no rule reads a column of these rows")
    keys = [F.lit(target_kind).alias("target_kind"), F.col(target).cast("string").alias("target_id")]
    if cycle:
        keys.append(F.col(cycle).alias("cycle"))
    return rows.select(*keys, F.inline(F.array_compact(F.array(*candidates))))


def rule_trigger_share(
    rows: DataFrame, rules: Iterable[TaskRule] = TASK_RULES, loose: float = 1.0, sensitive: float = 20.0
) -> DataFrame:
    """How often each rule fires on its rows, and whether to recalibrate it."""
    used = [r for r in rules if r.metric in rows.columns]
    if not used:
        raise ValueError("no rule reads a column of these rows")
    fired = [F.count_if(r.fires(F.col(r.metric))).alias(f"n{i}") for i, r in enumerate(used)]
    total = rows.agg(F.count(F.lit(1)).alias("n_rows"), *fired)
    entries = F.array(
        *(
            F.struct(
                F.lit(r.metric).alias("metric"),
                F.lit(r.priority).alias("priority"),
                F.col("n_rows"),
                F.col(f"n{i}").alias("n_fired"),
            )
            for i, r in enumerate(used)
        )
    )
    share = percent(F.col("n_fired"), F.col("n_rows"))
    return (
        total.select(F.inline(entries))
        .withColumn("share_pct", share)
        .withColumn(
            "verdict",
            F.when(F.col("share_pct") > sensitive, "too sensitive")
            .when(F.col("share_pct") < loose, "too loose")
            .otherwise("ok"),
        )
    )


def region_evidence(tables: Tables, sellers: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Recent orders of the given sellers by customer state.

    ``sellers`` has a ``seller_id`` column, one row per seller.
    """
    end = F.lit(as_of).cast("timestamp")
    bought = F.col("order_purchase_timestamp")
    recent = tables["orders"].filter((bought > end - F.make_dt_interval(F.lit(days))) & (bought <= end))
    owners = recent.select("order_id", "customer_id")
    outcomes = order_outcomes(recent).select("order_id", "is_late", "has_both_dates", "delivery_delay_days")
    lines = items_per_order(tables["order_items"].join(sellers.select("seller_id"), "seller_id"), "seller_id")
    places = tables["customers"].select("customer_id", "customer_state")
    facts = (
        lines.join(outcomes, "order_id").join(owners, "order_id").join(places, "customer_id", "left")
    )
    counts = facts.groupBy("seller_id", "customer_state").agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.count_if("is_late").alias("n_late"),
        F.avg(F.when(F.col("has_both_dates"), F.col("delivery_delay_days"))).alias("avg_delay_days"),
    )
    # at most one row per state: the window is small for every seller
    whole = F.sum("n_orders").over(Window.partitionBy("seller_id"))
    return counts.withColumn("share_pct", percent(F.col("n_orders"), whole))
