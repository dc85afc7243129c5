from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import rows
from orderwatch.functions import exact
from orderwatch.operators import marts
from orderwatch.plans import QUERIES


def with_rows(df, spark, *new):
    return df.unionByName(spark.createDataFrame(list(new), df.schema))


@pytest.mark.parametrize(
    ("seller", "orders", "delivered", "canceled", "delay", "late", "cancel", "price", "revenue"),
    [
        ("S1", 2, 2, 0, 4.0, 100.0, 0.0, 61.0, 122.0),
        ("S2", 3, 2, 0, -0.5, 50.0, 0.0, 220.0, 660.0),
        ("S3", 2, 2, 0, 3.5, 50.0, 0.0, 372.5, 745.0),
        ("S4", 2, 1, 1, -3.0, 0.0, 50.0, 245.0, 490.0),
    ],
)
def test_seller_delivery(tables, seller, orders, delivered, canceled, delay, late, cancel, price, revenue):
    for mart in (marts.seller_delivery_metrics(tables), marts.seller_scorecard(tables)):
        row = mart.filter(F.col("seller_id") == seller).first()
        assert (row.total_orders, row.delivered_orders, row.canceled_orders) == (orders, delivered, canceled)
        assert (row.avg_delivery_delay_days, row.delay_rate_pct, row.cancel_rate_pct) == (delay, late, cancel)
        assert row.avg_price == pytest.approx(price, abs=1e-4) and row.total_revenue == pytest.approx(revenue)


def test_review_risk(tables):
    found = rows(marts.review_risk_metrics(tables), "seller_id")
    assert set(found) == {"S1", "S2", "S3", "S4"}
    # o2 has two reviews: both count in the averages, the order counts once
    s1 = found["S1"]
    assert (s1["reviewed_orders"], s1["negative_reviews"], s1["positive_reviews"], s1["worst_review_score"]) == (2, 1, 1, 2)
    assert s1["avg_review_score"] == pytest.approx((5 + 3 + 2) / 3) and s1["avg_review_response_days"] == pytest.approx((1 + 0 + 3) / 3)
    assert (found["S2"]["avg_review_score"], found["S2"]["negative_review_rate_pct"]) == (3.0, 50.0)
    assert (found["S4"]["avg_review_score"], found["S4"]["negative_review_rate_pct"]) == (5.0, 0.0)


def test_orders_enriched(tables):
    found = rows(marts.orders_enriched(tables), "order_id")
    assert len(found) == 7
    assert [found[f"o{i}"]["delivery_delay_days"] for i in range(1, 8)] == [0, 8, 16, None, None, -9, -3]
    assert found["o2"]["payment_types"] == "credit_card, voucher"
    assert found["o2"]["total_payment"] == pytest.approx(407.3)
    assert found["o5"]["payment_types"] is None
    assert [found[f"o{i}"]["review_score"] for i in range(1, 8)] == [5, 2, 1, None, None, 4, 5]


def test_latest_review_wins_and_ties_break_by_id(spark, tables):
    old = tables["order_reviews"].filter("review_id = 'v1'").first().asDict()
    created = old["review_creation_date"]
    newer = old | {"review_id": "v9", "review_score": "1", "review_creation_date": created.replace(day=20)}
    tied = old | {"review_id": "v0", "review_score": "2"}
    reviews = with_rows(tables["order_reviews"], spark, newer, tied)
    found = rows(marts.orders_enriched({**tables, "order_reviews": reviews}), "order_id")
    assert found["o1"]["review_score"] == 1
    reviews = with_rows(tables["order_reviews"], spark, tied)
    assert rows(marts.orders_enriched({**tables, "order_reviews": reviews}), "order_id")["o1"]["review_score"] == 5


def test_same_day_delivery_is_late_without_delay(tables):
    # o1 comes on its due day, o7 before it; only o2 and o3 have days of delay
    row = marts.seller_delivery_metrics(tables).filter("seller_id = 'S1'").first()
    assert row.delay_rate_pct == 100.0
    assert row.avg_delivery_delay_days == pytest.approx((0 + 8) / 2)


def test_averages_weigh_items_and_counts_do_not(spark, tables):
    extra = [("o3", str(i), "rug", "S3", None, "100.00", "5.00") for i in (2, 3)]
    items = with_rows(tables["order_items"], spark, *extra)
    changed = {**tables, "order_items": items}
    row = marts.seller_delivery_metrics(changed).filter("seller_id = 'S3'").first()
    assert row.total_orders == 2 and row.delay_rate_pct == 50.0
    assert row.avg_delivery_delay_days == pytest.approx((3 * 16 - 9) / 4)
    review = marts.review_risk_metrics(changed).filter("seller_id = 'S3'").first()
    assert review.reviewed_orders == 2 and review.avg_review_score == pytest.approx((3 * 1 + 4) / 4)
    product = marts.product_quality_metrics(changed).filter("product_id = 'rug'").first()
    assert product.avg_unit_price == pytest.approx((700 + 100 * 2) / 3) and product.total_orders == 1


def test_two_reviews_repeat_items_in_product_averages(spark, tables):
    row = marts.product_quality_metrics(tables).filter("product_id = 'drill'").first()
    # o2 has two reviews, o6 one
    assert row.avg_unit_price == pytest.approx((320 * 2 + 300) / 3)
    assert row.avg_review_score == pytest.approx((3 + 2 + 4) / 3)
    assert (row.reviewed_orders, row.defect_signals, row.defect_rate_pct) == (2, 1, 50.0)
    items = with_rows(tables["order_items"], spark, ("o2", "3", "drill", "S2", None, "80.00", "4.00"))
    row = marts.product_quality_metrics({**tables, "order_items": items}).filter("product_id = 'drill'").first()
    # two items times two reviews, and one of each
    assert row.avg_unit_price == pytest.approx((320 * 2 + 80 * 2 + 300) / 5)
    assert row.avg_review_score == pytest.approx((3 * 2 + 2 * 2 + 4) / 5)
    assert (row.reviewed_orders, row.defect_signals, row.defect_rate_pct) == (2, 1, 50.0)


def test_odd_values(spark, tables):
    extra = [("o7", "2", "saw", "S4", None, "0", "5.00"), ("o99", "1", "hammer", "S9", None, "x", "1")]
    items = with_rows(tables["order_items"], spark, *extra)
    changed = {**tables, "order_items": items}
    ratios = rows(marts.freight_ratio(changed), "seller_id")
    assert ratios["S4"]["avg_freight_ratio"] == pytest.approx((20 / 250 + 24 / 240) / 2)
    assert "S9" not in ratios  # its order is unknown
    assert marts.seller_delivery_metrics(changed).filter("seller_id = 'S9'").count() == 0
    scores = tables["order_reviews"].withColumn("review_score", F.concat("review_score", F.lit(".0")))
    found = marts.review_risk_metrics({**tables, "order_reviews": scores}).filter("seller_id = 'S3'").first()
    assert (found.negative_reviews, found.worst_review_score) == (1, 1)


def test_window_limits_freight_or_everything(tables):
    some = rows(marts.seller_scorecard(tables, start="2023-03-10", end="2023-03-16"), "seller_id")
    assert some["S2"]["total_orders"] == 3 and some["S2"]["avg_freight_ratio"] == pytest.approx((10 / 40 + 30 / 300) / 2)
    assert some["S1"]["avg_freight_ratio"] is None
    everything = rows(marts.seller_scorecard(tables, start="2023-03-10", end="2023-03-16", window_scope="all"), "seller_id")
    assert set(everything) == {"S2", "S3", "S4"} and everything["S2"]["total_orders"] == 2
    with pytest.raises(ValueError, match="window_scope"):
        marts.seller_scorecard(tables, window_scope="some")


def test_states_count_an_order_once(spark, tables):
    sellers = tables["sellers"].withColumn("seller_state", F.lit("SP"))
    row = marts.state_delivery_metrics({**tables, "sellers": sellers}).first()
    assert (row.total_orders, row.delivered_orders, row.delay_rate_pct) == (7, 5, 60.0)


def test_value_ranges(spark, star_folder):
    from orderwatch.sources.star import load_star

    star = load_star(spark, star_folder)
    card = marts.seller_scorecard(star)
    bad = card.filter("not (delay_rate_pct between 0 and 100) or not (cancel_rate_pct between 0 and 100) "
                      "or not (avg_review_score between 1 and 5) or delivered_orders > total_orders")
    assert bad.count() == 0 and card.count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_expand_nothing_and_multiply_nothing(spark, star_folder):
    from orderwatch.sources.star import load_star

    star = load_star(spark, star_folder)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(marts.seller_delivery_metrics(star))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "Expand" not in text and "Cartesian" not in text and "NestedLoop" not in text
    # each base table once, lines by (order, seller) then by order, result by seller
    assert text.count("Exchange hashpartitioning(seller_id") == 2
    assert text.count("Exchange hashpartitioning(order_id") == 3
    scan = next(line for line in text.splitlines() if "lineitem.parquet" in line)
    assert "l_shipdate" not in scan and "l_tax" not in scan


def test_sums_do_not_depend_on_the_order_of_addition(spark):
    values = [0.1, 0.2, 0.3, 1e9 + 0.01, 3.335, 1e-6, 7e14, 0.7] * 40
    seen = set()
    for shuffle in (1, 7, 41):
        df = spark.createDataFrame([(v,) for v in values[shuffle:] + values[:shuffle]], "v double").repartition(shuffle)
        seen.add(df.agg(F.sum(exact(F.col("v"))).cast("double")).first()[0])
    assert seen == {float(sum(Decimal(repr(v)) for v in values))}
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (1e30,), (None,), (2.0000005,)], "v double")
    assert [r[0] for r in odd.select(exact(F.col("v")).cast("double")).collect()] == [None, None, None, None, 2.000001]


def test_shown_texts_are_the_same_for_any_partitioning(spark, star_folder):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    try:
        for partitions in ("1", "8", "200"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            seen.append(sorted(map(str, QUERIES["auto_tasks"](spark, star_folder).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert seen[0] and seen[0] == seen[1] == seen[2]
