"""The four analytical marts and the freight ratio.

Each mart counts distinct orders per seller or product but averages over item
rows. Both come from one two-level aggregation: lines are first reduced to one
row per (order, key) with sums and counts, then joined with one row per order,
then reduced to the key. Nothing is expanded, a hot seller or product is spread
over its orders, and a hot order is reduced before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import as_double, as_int, exact, exact_ratio, percent, ratio

Tables = Mapping[str, DataFrame]

MART_INPUTS = {
    "orders_enriched": {"orders", "customers", "order_payments", "order_reviews"},
    "seller_delivery_metrics": {"orders", "order_items", "sellers"},
    "review_risk_metrics": {"orders", "order_items", "order_reviews", "sellers"},
    "product_quality_metrics": {"orders", "order_items", "order_reviews", "products"},
}


# Decimal places kept of a ratio before it is summed.
RATIO_PLACES = 12


def purchase_window(start: str | None = None, end: str | None = None) -> Column:
    """Inclusive bounds on the purchase time; no bound keeps every row."""
    keep = F.lit(True)
    bought = F.col("order_purchase_timestamp")
    if start:
        keep = keep & (bought >= F.lit(start).cast("timestamp"))
    if end:
        keep = keep & (bought <= F.lit(end).cast("timestamp"))
    return keep


# --------------------------------------------------------------- per order


def payments_per_order(payments: DataFrame) -> DataFrame:
    # The set of payment types is a closed list, so the array stays short even
    # for an order with very many payments.
    kinds = F.array_sort(F.collect_set("payment_type"))
    return payments.groupBy("order_id").agg(
        F.sum(exact(as_double("payment_value"))).cast("double").alias("total_payment"),
        F.array_join(kinds, ", ").alias("type_list"),
    ).select(
        "order_id",
        "total_payment",
        F.nullif(F.col("type_list"), F.lit("")).alias("payment_types"),
    )


def reviews_per_order(reviews: DataFrame, period: str | None = None) -> DataFrame:
    """Review counts and sums per order, and the score of the latest review.

    With ``period`` (``week``, ``month``) orders are split by creation period.
    """
    score = as_int("review_score")
    exact = as_double("review_score")
    created = F.col("review_creation_date").try_cast("timestamp")
    answer_days = F.datediff(F.col("review_answer_timestamp").try_cast("timestamp"), created)
    keys = ["order_id"]
    if period:
        reviews = reviews.withColumn("period", F.date_trunc(period, created).cast("date"))
        keys.append("period")
    return reviews.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_reviews"),
        F.sum(exact).alias("score_sum"),
        F.count(exact).alias("n_scored"),
        F.min(score).alias("worst_score"),
        F.coalesce(F.bool_or(score <= 2), F.lit(False)).alias("has_negative"),
        F.coalesce(F.bool_or(score >= 4), F.lit(False)).alias("has_positive"),
        F.sum(answer_days).alias("answer_days_sum"),
        F.count(answer_days).alias("n_answered"),
        F.max_by(score, F.struct(created, "review_id")).alias("review_score"),
    )


def order_outcomes(orders: DataFrame) -> DataFrame:
    """Status, delay and lateness of every order."""
    delivered = F.col("order_delivered_customer_date")
    estimated = F.col("order_estimated_delivery_date")
    both = (F.col("order_status") == "delivered") & delivered.isNotNull() & estimated.isNotNull()
    return orders.select(
        "order_id",
        "order_status",
        "order_purchase_timestamp",
        F.datediff(delivered, estimated).alias("delivery_delay_days"),
        both.alias("has_both_dates"),
        # compared as times: a same-day arrival after a midnight promise is late
        (both & (delivered > estimated)).alias("is_late"),
    )


def items_per_order(items: DataFrame, *keys: str) -> DataFrame:
    """Line counts and sums per (order, key); sums are decimals and so exact."""
    price = as_double("price")
    freight = ratio(as_double("freight_value"), price)
    return items.groupBy("order_id", *keys).agg(
        F.count(F.lit(1)).alias("n_items"),
        F.sum(exact(price)).alias("price_sum"),
        F.count(price).alias("n_priced"),
        F.sum(exact(freight, RATIO_PLACES)).alias("freight_sum"),
        F.count(freight).alias("n_freight"),
    )


# ---------------------------------------------------------------- measures


def delivery_measures() -> dict[str, Column]:
    """Delivery columns over (order, key) rows joined with order outcomes."""
    status, weight, dated = F.col("order_status"), F.col("n_items"), F.col("has_both_dates")
    total = F.count("order_id")
    delivered = F.count_if(status == "delivered")
    canceled = F.count_if(status == "canceled")
    delay_sum = F.sum(F.when(dated, F.col("delivery_delay_days") * weight))
    return {
        "total_orders": total,
        "delivered_orders": delivered,
        "canceled_orders": canceled,
        "avg_delivery_delay_days": ratio(delay_sum, F.sum(F.when(dated, weight))),
        "delay_rate_pct": percent(F.count_if("is_late"), delivered),
        "cancel_rate_pct": percent(canceled, total),
        "avg_price": exact_ratio(F.sum("price_sum"), F.sum("n_priced")),
        "total_revenue": F.sum("price_sum").cast("double"),
    }


def review_measures() -> dict[str, Column]:
    """Review columns over (order, key) rows joined with reviews per order."""
    weight = F.col("n_items")
    reviewed = F.count_if(F.col("n_reviews") > 0)
    negative = F.count_if("has_negative")
    return {
        "reviewed_orders": reviewed,
        "avg_review_score": ratio(F.sum(F.col("score_sum") * weight), F.sum(F.col("n_scored") * weight)),
        "negative_reviews": negative,
        "positive_reviews": F.count_if("has_positive"),
        "negative_review_rate_pct": percent(negative, reviewed),
        "avg_review_response_days": ratio(
            F.sum(F.col("answer_days_sum") * weight), F.sum(F.col("n_answered") * weight)
        ),
        "worst_review_score": F.min("worst_score"),
    }


def _measure(facts: DataFrame, keys: list[str], measures: Mapping[str, Column]) -> DataFrame:
    return facts.groupBy(*keys).agg(*(c.alias(n) for n, c in measures.items()))


# ------------------------------------------------------------------- marts


def order_states(tables: Tables) -> DataFrame:
    """Orders with delay, payments and the latest review (one row per order)."""
    orders = tables["orders"]
    delay = F.datediff("order_delivered_customer_date", "order_estimated_delivery_date")
    latest = reviews_per_order(tables["order_reviews"]).select("order_id", "review_score")
    return (
        orders.withColumn("delivery_delay_days", delay)
        .join(payments_per_order(tables["order_payments"]), "order_id", "left")
        .join(latest, "order_id", "left")
    )


def orders_enriched(tables: Tables) -> DataFrame:
    """One row per order with customer place, delay, payments and review score.

    The three per-order joins share one partitioning; the customer join, whose
    key may be skewed, comes last so that AQE can split it.
    """
    places = tables["customers"].select("customer_id", "customer_city", "customer_state")
    return (
        order_states(tables)
        .join(places, "customer_id", "left")
        .select(
            "order_id",
            "customer_id",
            "customer_city",
            "customer_state",
            "order_status",
            "order_purchase_timestamp",
            "order_approved_at",
            "order_delivered_carrier_date",
            "order_delivered_customer_date",
            "order_estimated_delivery_date",
            "delivery_delay_days",
            "total_payment",
            "payment_types",
            "review_score",
        )
    )


def seller_delivery_metrics(tables: Tables) -> DataFrame:
    """Delivery performance per seller with at least one item."""
    facts = items_per_order(tables["order_items"], "seller_id").join(
        order_outcomes(tables["orders"]), "order_id", "left"
    )
    places = tables["sellers"].select("seller_id", "seller_city", "seller_state")
    measures = delivery_measures()
    return (
        _measure(facts, ["seller_id"], measures)
        .join(places, "seller_id")
        .select("seller_id", "seller_city", "seller_state", *measures)
    )


def state_delivery_metrics(tables: Tables) -> DataFrame:
    """Delivery performance per seller state, from order counts of the state.

    An order served by two sellers of a state counts once there, so the state
    rows are not sums of seller rows.
    """
    states = tables["sellers"].select("seller_id", "seller_state")
    lines = items_per_order(tables["order_items"], "seller_id").join(states, "seller_id")
    sums = ("n_items", "price_sum", "n_priced", "freight_sum", "n_freight")
    lines = lines.groupBy("order_id", "seller_state").agg(*(F.sum(c).alias(c) for c in sums))
    facts = lines.join(order_outcomes(tables["orders"]), "order_id", "left")
    return _measure(facts, ["seller_state"], delivery_measures())


def review_risk_metrics(tables: Tables, period: str | None = None) -> DataFrame:
    """Review risk per seller, optionally per creation period."""
    known = tables["orders"].select("order_id")
    facts = (
        items_per_order(tables["order_items"], "seller_id")
        .join(known, "order_id", "left_semi")
        .join(reviews_per_order(tables["order_reviews"], period), "order_id")
    )
    return _measure(facts, ["seller_id", *(["period"] if period else [])], review_measures())


def product_lines(
    tables: Tables, start: str | None = None, end: str | None = None, period: str | None = None
) -> DataFrame:
    """Product items per order, restricted or split by purchase time if asked.

    Without a window or a period the order table is not needed and not read.
    """
    lines = items_per_order(tables["order_items"], "product_id")
    bought = tables["orders"].filter(purchase_window(start, end))
    if period:
        month = F.date_trunc(period, "order_purchase_timestamp").cast("date")
        return lines.join(bought.select("order_id", month.alias("period")), "order_id")
    if start or end:
        return lines.join(bought.select("order_id"), "order_id", "left_semi")
    return lines


def product_measures() -> dict[str, Column]:
    # an order with two reviews contributes its items twice to the averages
    copies = F.greatest(F.coalesce("n_reviews", F.lit(0)), F.lit(1))
    reviews = review_measures()
    return {
        "total_orders": F.count("order_id"),
        "reviewed_orders": reviews["reviewed_orders"],
        "avg_review_score": reviews["avg_review_score"],
        "defect_signals": reviews["negative_reviews"],
        "defect_rate_pct": reviews["negative_review_rate_pct"],
        "avg_unit_price": exact_ratio(F.sum(F.col("price_sum") * copies), F.sum(F.col("n_priced") * copies)),
    }


def product_quality_metrics(
    tables: Tables, start: str | None = None, end: str | None = None, period: str | None = None
) -> DataFrame:
    """Quality signals per product that was ordered, optionally per period."""
    facts = product_lines(tables, start, end, period).join(
        reviews_per_order(tables["order_reviews"]), "order_id", "left"
    )
    measures = product_measures()
    details = tables["products"].select(
        "product_id",
        "product_category_name",
        as_double("product_weight_g").alias("weight_g"),
        as_int("product_photos_qty").alias("photos_qty"),
    )
    keys = ["product_id", *(["period"] if period else [])]
    return (
        _measure(facts, keys, measures)
        .join(details, "product_id")
        .select("product_id", "product_category_name", *keys[1:], *measures, "weight_g", "photos_qty")
    )


def freight_ratio(tables: Tables, start: str | None = None, end: str | None = None) -> DataFrame:
    """Mean freight-to-price ratio of a seller's items in the purchase window."""
    lines = items_per_order(tables["order_items"], "seller_id")
    orders = tables["orders"].filter(purchase_window(start, end)).select("order_id")
    return (
        lines.join(orders, "order_id", "left_semi")
        .groupBy("seller_id")
        .agg(exact_ratio(F.sum("freight_sum"), F.sum("n_freight")).alias("avg_freight_ratio"))
    )


def seller_scorecard(
    tables: Tables,
    period: str | None = None,
    start: str | None = None,
    end: str | None = None,
    window_scope: str = "freight",
) -> DataFrame:
    """Delivery, review and freight measures of a seller in one pass.

    Lines, orders and reviews meet once, on the order key, instead of once per
    mart. ``period`` adds the purchase period to the grain. The purchase window
    limits the freight ratio only (``freight``) or every measure (``all``).
    """
    if window_scope not in ("freight", "all"):
        raise ValueError(f"window_scope must be 'freight' or 'all', got {window_scope!r}")
    in_window = purchase_window(start, end)
    outcomes = order_outcomes(tables["orders"]).withColumn("is_known", F.lit(True))
    known = F.coalesce("is_known", F.lit(False))
    facts = items_per_order(tables["order_items"], "seller_id").join(outcomes, "order_id", "left")
    if window_scope == "all":
        facts = facts.filter(in_window)
    facts = facts.join(reviews_per_order(tables["order_reviews"]), "order_id", "left")
    # a review counts only when its order exists
    facts = facts.withColumns(
        {c: F.when(known, F.col(c)) for c in ("n_reviews", "has_negative", "has_positive", "worst_score")}
        | {c: F.when(known, F.col(c)) for c in ("score_sum", "n_scored", "answer_days_sum", "n_answered")}
    )
    keys = ["seller_id"]
    if period:
        facts = facts.withColumn("period", F.date_trunc(period, "order_purchase_timestamp").cast("date"))
        keys.append("period")
    usable = known & F.coalesce(in_window, F.lit(False))
    freight = exact_ratio(F.sum(F.when(usable, F.col("freight_sum"))), F.sum(F.when(usable, F.col("n_freight"))))
    measures = (
        delivery_measures()
        | review_measures()
        | {
            "avg_freight_ratio": freight,
            "max_delivery_delay_days": F.max(F.when(F.col("has_both_dates"), F.col("delivery_delay_days"))),
        }
    )
    places = tables["sellers"].select("seller_id", "seller_city", "seller_state")
    return (
        _measure(facts, keys, measures)
        .join(places, "seller_id")
        .select("seller_id", "seller_city", "seller_state", *keys[1:], *measures)
    )


def build_marts(tables: Tables, register: bool = False) -> dict[str, DataFrame]:
    """Every mart whose inputs are there, optionally as temporary views."""
    builders = {
        "orders_enriched": orders_enriched,
        "seller_delivery_metrics": seller_delivery_metrics,
        "review_risk_metrics": review_risk_metrics,
        "product_quality_metrics": product_quality_metrics,
    }
    marts = {n: build(tables) for n, build in builders.items() if MART_INPUTS[n].issubset(tables)}
    if register:
        for name, mart in marts.items():
            mart.createOrReplaceTempView(name)
    return marts
