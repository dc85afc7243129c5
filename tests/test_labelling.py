from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from orderwatch.operators import evaluation, labelling


def one(spark, text, expression):
    return spark.createDataFrame([(text,)], "t string").select(expression(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "cleaned"),
    [
        ("<think>why</think> 42 ", "42"), ("plain", "plain"), ("< Think >a\nb</ THINK >\n x", "x"),
        ("<think>a</think>x<think>b</think>y", "xy"), ("<think>a <think> b</think> rest</think> c", "rest</think> c"),
        ("\U0002DFE8 think \U0002DFE9 secret \U0002DFE8/think\U0002DFE9 out", "out"), ("<think>open only", "<think>open only"), ("", ""),
        ("<\u00a0think>a</think\u3000>\u00a0\u3000b\u2003", "b"),
    ],
)
def test_reasoning_is_removed(spark, text, cleaned):
    assert one(spark, text, labelling.strip_reasoning) == cleaned


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ('```json\n{"a": 1}\n```', {"a": 1}), ('```\n[1, 2]\n``` and {"b": 2}', [1, 2]), ('The result is {"s": 0.9}.', {"s": 0.9}),
        ("No JSON", None), ("```json\nbroken\n``` but {\"c\": {\"d\": [1]}} ok", {"c": {"d": [1]}}),
        ("values [1, {\"a\": 2}] end", {"a": 2}), ("{broken} then [3]", [3]), ('{"a": 1} and {"b": 2}', None), ("", None),
        ('{"a": 1}] [{"b": 2}', None), ('{"a": 1}} {"x": {"b": 2}', None), ('{"a": 1}, {"b": 2}', None),
    ],
)
def test_json_block(spark, text, value):
    found = one(spark, text, labelling.json_block)
    assert (json.loads(found) if found is not None else None) == value


def test_refusal(spark):
    assert one(spark, "<think>x</think> no_evidence: nothing", labelling.is_refusal) is True
    assert one(spark, "The answer is NO_EVIDENCE", labelling.is_refusal) is False
    assert one(spark, "\u3000NO_EVIDENCE", labelling.is_refusal) is True
    assert one(spark, "<think>x</think>\u00a0no_evidence", labelling.is_refusal) is True


@pytest.mark.parametrize(
    ("question", "label"),
    [
        ("Check seller_A, if >30% create P0 task", "mixed"), ("Do this and then that", "mixed"), ("Create a task", "create_task"),
        ("Assign it", "create_task"), ("What is the threshold?", "sop_qa"), ("How to HANDLE this", "sop_qa"),
        ("List sellers with delay_rate > 20%", "metric_query"), ("Tell me a joke", "unknown"), ("top sellers", "metric_query"),
        ("Show top sellers", "sop_qa"),  # "show top" holds "how to"
    ],
)
def test_intents(spark, question, label):
    assert one(spark, question, labelling.intent_label) == label


def test_plans(spark):
    outputs = [
        ("q1", '<think>x</think>{"metric_name": "order_risk", "filters": {"limit": 5}, "need_sql": true}'),
        ("q2", "nothing here"), ("q3", '[1]'), ("q4", '{"intent": "mine", "filters": null}'),
    ]
    df = labelling.normalise_plan(spark.createDataFrame(outputs, "q string, o string"), "o", "q")
    found = {r.q: r for r in df.collect()}
    first = found["q1"].plan
    assert (first.intent, first.metric_name, first.filters, first.need_sql) == ("q1", "order_risk", {"limit": "5"}, True)
    assert found["q1"].plan_error is None and found["q2"].plan_error and found["q3"].plan_error
    assert found["q2"].plan.filters == {} and found["q2"].plan.need_sql is False
    assert found["q4"].plan.intent == "mine" and found["q4"].plan.filters == {}


QUESTION = "id string, question string, expected_intent string, relevant_sop string, expected_tools array<string>, difficulty string"


def test_evaluation(spark):
    questions = spark.createDataFrame(
        [
            ("1", "List top sellers", "metric_query", "SOP-DELIVERY-001", ["get_top_risky_sellers"], "easy"),
            ("2", "What is the policy", "sop_qa", "other", [], "easy"),
            ("3", "Create a task", "mixed", None, ["create_inspection_task"], "hard"),
            ("4", "hello", "unknown", None, [], "medium"),
        ],
        QUESTION,
    )
    results = spark.createDataFrame(
        [("1", "docs/Delivery_Risk.md"), ("1", "docs/x.md"), ("2", "docs/y.md")], "query_id string, source string"
    )
    hits = evaluation.source_hits(questions, results)
    assert {r.id: r.source_hit for r in hits.collect()} == {"1": True, "2": False}
    done = evaluation.evaluate(questions, F.lit(True), F.col("difficulty") != "hard", hits)
    row = evaluation.summary(done).first()
    assert (row.n_questions, row.intent_accuracy, row.metric_success, row.source_hit_rate, row.task_success) == (
        4, 75.0, 100.0, 50.0, 0.0,
    )
    groups = {(r.dimension, r.value): (r.n_questions, r.intent_accuracy) for r in evaluation.by_group(done).collect()}
    assert groups[("difficulty", "easy")] == (2, 100.0) and groups[("intent", "mixed")] == (1, 0.0)
    assert set(evaluation.report_tables(done)) == {"summary", "by_difficulty", "by_intent", "questions"}


def test_empty_evaluation(spark):
    none = evaluation.evaluate(spark.createDataFrame([], QUESTION), F.lit(True), F.lit(True))
    row = evaluation.summary(none).first()
    assert (row.n_questions, row.intent_accuracy, row.metric_success, row.source_hit_rate, row.task_success) == (0, 0.0, 100.0, 100.0, 100.0)
