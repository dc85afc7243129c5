from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import rows
from orderwatch.operators import marts, policy


def column_of(spark, schema, values, column):
    df = spark.createDataFrame(values, schema)
    return [r.x for r in df.select(column.alias("x")).collect()]


def test_delivery_tier(spark):
    schema = "delay_rate_pct double, avg_delivery_delay_days double, max_delivery_delay_days int"
    values = [
        (30.1, 0.0, 0), (0.0, 0.0, 16), (30.0, 0.0, 0), (15.0, 0.0, 15), (0.0, 7.5, 0), (5.0, 0.0, 0), (0.0, 3.0, 0),
        (4.9, 2.9, 0), (None, None, None),
    ]
    assert column_of(spark, schema, values, policy.delivery_tier()) == [
        "P0", "P0", "P1", "P1", "P1", "P2", "P2", "P3", "P3",
    ]


def test_review_tier(spark):
    schema = "negative_review_rate_pct double, avg_review_score double, unsafe boolean"
    values = [(50.1, 4.0, False), (0.0, 4.0, True), (50.0, 4.0, False), (0.0, 2.4, False), (10.0, 4.0, False), (9.9, 4.0, False)]
    assert column_of(spark, schema, values, policy.review_tier(F.col("unsafe"))) == ["P0", "P0", "P1", "P1", "P2", "P3"]


def test_product_tier(spark):
    schema = "avg_unit_price double, defect_rate_pct double"
    values = [(99.0, 40.0), (99.0, 40.1), (100.0, 30.1), (500.0, 20.5), (500.1, 20.5), (500.1, 10.5), (100.0, 12.0), (99.0, 9.0), (1.0, None)]
    assert column_of(spark, schema, values, policy.product_tier()) == ["P1", "P0", "P0", "P1", "P0", "P1", "P2", "P3", "P3"]
    assert column_of(spark, schema, values[:3], policy.price_band()) == ["<100", "<100", "100-500"]


def test_small_sample(spark):
    df = spark.createDataFrame([("P0", 4), ("P0", 5), ("P1", None)], "level string, n int")
    found = policy.guard_small_sample(df, "level", "n", 5).collect()
    assert [(r.level, r.sample_note) for r in found] == [
        ("P3", "insufficient sample"), ("P0", None), ("P3", "insufficient sample"),
    ]


def test_triage(spark, tables):
    found = rows(policy.triage_reviews(tables["order_reviews"]), "review_id")
    assert set(found) == {"v3", "v4"}
    assert found["v3"]["category"] == "logistics" and found["v3"]["owner"] == "carrier / seller"
    assert found["v4"]["matched"] == ["quality"]
    texts = [("1", "1", "包装差 又 贵"), ("2", "2", None), ("3", "1", "Seller was RUDE"), ("4", "5", "slow")]
    df = spark.createDataFrame(texts, "review_id string, review_score string, review_comment_message string")
    found = rows(policy.triage_reviews(df), "review_id")
    assert found["1"]["matched"] == ["logistics", "price"] and found["2"]["category"] == "other"
    assert found["3"]["category"] == "service" and "4" not in found


def test_safety_words_need_five_reviews_of_one_product(spark, tables):
    orders = [f"o{i}" for i in range(6)]
    reviews = spark.createDataFrame(
        [(f"r{o}", o, "1", None, "battery 漏液", None, None) for o in orders],
        "review_id string, order_id string, review_score string, review_comment_title string, "
        "review_comment_message string, review_creation_date timestamp, review_answer_timestamp timestamp",
    )
    items = [(o, "1", "p1" if i < 5 else "p2", "s1" if i < 5 else "s2") for i, o in enumerate(orders)]
    items += [(orders[0], "2", "p1", "s1")]
    lines = spark.createDataFrame(items, "order_id string, order_item_id string, product_id string, seller_id string")
    found = policy.unsafe_sellers({"order_items": lines, "order_reviews": reviews}).collect()
    assert [(r.seller_id, r.n_unsafe_products) for r in found] == [("s1", 1)]
    counts = rows(policy.unsafe_products({"order_items": lines, "order_reviews": reviews}), "product_id")
    assert (counts["p1"]["n_unsafe"], counts["p2"]["n_unsafe"]) == (5, 1)


def trend_tables(spark, weeks):
    """One order per review; ``weeks`` maps week number to its scores."""
    start = dt.datetime(2024, 1, 1)
    reviews, orders, items = [], [], []
    for week, scores in weeks.items():
        for i, score in enumerate(scores):
            order = f"o{week}_{i}"
            created = start + dt.timedelta(days=7 * week + i % 5)
            reviews.append((f"r{order}", order, score, created, created))
            orders.append((order,))
            items.append((order, "p1", "s1", 10.0, 1.0))
    return {
        "order_reviews": spark.createDataFrame(
            reviews,
            "review_id string, order_id string, review_score int, review_creation_date timestamp, review_answer_timestamp timestamp",
        ),
        "orders": spark.createDataFrame(orders, "order_id string"),
        "order_items": spark.createDataFrame(
            items, "order_id string, product_id string, seller_id string, price double, freight_value double"
        ),
        "products": spark.createDataFrame([("p1", "toys")], "product_id string, product_category_name string"),
    }


def test_seller_trend(spark):
    weeks = {0: [5, 5, 5, 5], 1: [1, 5, 5, 5], 2: [1, 1, 5, 5], 3: [1, 1, 1, 5], 5: [1, 1, 1, 1], 6: [5]}
    found = rows(policy.seller_week_trend(trend_tables(spark, weeks)), "period")
    by_week = {(d - dt.date(2024, 1, 1)).days // 7: r for d, r in found.items()}
    assert [w for w, r in by_week.items() if r["rising_alert"]] == [2, 3]  # week 5 follows a gap
    assert sorted(w for w, r in by_week.items() if r["manual_review"]) == [3, 5]


def test_category_trend(spark):
    weeks = {0: [5] * 10, 1: [1] + [5] * 9, 2: [1] * 2 + [5] * 8, 3: [1] * 3 + [5] * 7, 4: [1] * 4 + [5] * 6}
    found = rows(policy.category_week_trend(trend_tables(spark, weeks)), "period")
    by_week = {(d - dt.date(2024, 1, 1)).days // 7: r for d, r in found.items()}
    assert [w for w, r in sorted(by_week.items()) if r["strategy_alert"]] == [4]
    assert [w for w, r in sorted(by_week.items()) if r["inspection_alert"]] == [3, 4]


def test_auto_tasks(spark, tables):
    card = marts.seller_scorecard(tables).withColumn("cycle", F.lit("2023-03"))
    found = policy.auto_tasks(card, "seller", "seller_id", "cycle").collect()
    kinds = {(r.target_id, r.task_type): (r.priority, r.assignee) for r in found}
    assert kinds == {
        (s, kind): who
        for s in ("S1", "S2", "S3")
        for kind, who in (("delivery_risk", ("P0", "区域经理")), ("review_triage", ("P1", "客服专员")))
    }
    s2 = next(r for r in found if (r.target_id, r.task_type) == ("S2", "delivery_risk"))
    assert s2.title == "[物流风险] S2 延迟率 50.00%" and s2.sop_reference == "SOP-DELIVERY-001 §1.2"
    assert s2.description == "卖家: S2 (Joinville, SC)\n延迟率: 50.00%\n平均延迟: -0.50 天\n总订单: 3"
    # a share of negative reviews above one half is urgent
    worse = tables["order_reviews"].filter("order_id <> 'o6'")
    card = marts.seller_scorecard({**tables, "order_reviews": worse})
    urgent = policy.auto_tasks(card, "seller", "seller_id").filter("task_type = 'review_triage' and priority = 'P0'")
    assert {(r.target_id, r.assignee) for r in urgent.collect()} == {("S2", "客服主管"), ("S3", "客服主管")}
    products = policy.auto_tasks(marts.product_quality_metrics(tables), "product", "product_id").collect()
    assert {(r.target_id, r.priority) for r in products} == {("lamp", "P0"), ("drill", "P0"), ("rug", "P0")}
    with pytest.raises(ValueError, match="no rule"):
        policy.auto_tasks(tables["sellers"], "seller", "seller_id")


def test_rule_share(spark):
    df = spark.createDataFrame([(31.0,), (20.0,), (15.0,), (1.0,), (None,)], "delay_rate_pct double")
    found = {r.priority: (r.n_fired, r.n_rows, r.share_pct, r.verdict) for r in policy.rule_trigger_share(df).collect()}
    assert found == {"P0": (1, 5, 20.0, "ok"), "P1": (2, 5, 40.0, "too sensitive")}


def test_region_evidence(tables):
    found = policy.region_evidence(tables, tables["sellers"].filter("seller_id in ('S2', 'S4')"), "2023-03-31").collect()
    assert {(r.seller_id, r.customer_state): (r.n_orders, r.n_late, r.share_pct) for r in found} == {
        ("S2", "PR"): (1, 0, 33.33), ("S2", "PE"): (1, 1, 33.33), ("S2", "RS"): (1, 0, 33.33),
        ("S4", "CE"): (1, 0, 50.0), ("S4", "PE"): (1, 0, 50.0),
    }
    assert policy.region_evidence(tables, tables["sellers"], "2023-03-31", days=1).count() == 0
