"""Scores of an evaluation run and their break-downs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import half_even
from .labelling import intent_label

CREATE_TOOL = "create_inspection_task"

# Tools that read metric data, and the token that the source of
# each procedure document contains.
METRIC_TOOLS = (
    "get_top_risky_sellers", "get_seller_profile", "get_order_risk", "get_category_quality_risk",
    "list_inspection_tasks",
)
SOURCE_TOKENS = {
    "SOP-DELIVERY-001": "delivery_risk",
    "SOP-REVIEW-002": "review_triage",
    "SOP-PRODUCT-003": "product_quality",
    "SOP-TASK-004": "inspection_task",
}


def source_token(reference: Column, tokens: Mapping[str, str] = SOURCE_TOKENS) -> Column:
    """Token to look for in a source; an unknown reference is its own token."""
    token = F.lower(reference)
    for name, value in tokens.items():
        token = F.when(reference == name, value).otherwise(token)
    return token


def source_hits(questions: DataFrame, results: DataFrame, tokens: Mapping[str, str] = SOURCE_TOKENS) -> DataFrame:
    """Per question with a reference: whether a retrieved source has its token.

    ``results`` are the rows of :func:`retrieval.retrieve` with the question id
    as query_id.
    """
    expected = questions.filter(F.col("relevant_sop").isNotNull() & (F.col("relevant_sop") != ""))
    expected = expected.select("id", F.lower(source_token(F.col("relevant_sop"), tokens)).alias("token"))
    found = results.select(F.col("query_id").alias("id"), F.lower("source").alias("found_source"))
    hit = F.bool_or(F.contains("found_source", "token"))
    return (
        expected.join(found, "id", "left")
        .groupBy("id")
        .agg(F.coalesce(hit, F.lit(False)).alias("source_hit"))
    )


def evaluate(questions: DataFrame, metric_ok: Column, task_ok: Column, hits: DataFrame | None = None) -> DataFrame:
    """One row per question with its label and four verdicts.

    ``metric_ok`` and ``task_ok`` say whether the metric and the task step
    worked; they count only for questions that use such a tool.
    """
    uses = F.arrays_overlap("expected_tools", F.array(*map(F.lit, METRIC_TOOLS)))
    creates = F.array_contains("expected_tools", CREATE_TOOL)
    actual = intent_label(F.col("question"))
    rows = questions.withColumns(
        {
            "actual_intent": actual,
            "intent_correct": actual == F.col("expected_intent"),
            "metric_ok": F.when(uses, metric_ok).otherwise(True),
            "task_ok": F.when(creates, task_ok).otherwise(True),
        }
    )
    referenced = F.col("relevant_sop").isNotNull() & (F.col("relevant_sop") != "")
    if hits is None:
        return rows.withColumn("source_ok", F.when(~referenced, True))
    rows = rows.join(hits, "id", "left")
    verdict = F.when(referenced, F.coalesce("source_hit", F.lit(False))).otherwise(True)
    return rows.withColumn("source_ok", verdict).drop("source_hit")


def _rate(ok: Column, scope: Column) -> Column:
    share = F.avg(F.when(scope, ok.cast("double"))) * 100
    return half_even(share, 1)


def summary(evaluated: DataFrame) -> DataFrame:
    """The four rates, each over the questions it applies to."""
    referenced = F.col("relevant_sop").isNotNull() & (F.col("relevant_sop") != "")
    metric = F.col("expected_intent").isin("metric_query", "mixed")
    creates = F.array_contains("expected_tools", CREATE_TOOL)
    full = F.lit(100.0)
    return evaluated.agg(
        F.count(F.lit(1)).alias("n_questions"),
        F.coalesce(_rate(F.col("intent_correct"), F.lit(True)), F.lit(0.0)).alias("intent_accuracy"),
        F.coalesce(_rate(F.col("metric_ok"), metric), full).alias("metric_success"),
        F.coalesce(_rate(F.col("source_ok"), referenced), full).alias("source_hit_rate"),
        F.coalesce(_rate(F.col("task_ok"), creates), full).alias("task_success"),
    )


def by_group(evaluated: DataFrame) -> DataFrame:
    """Count and intent accuracy by difficulty and by expected intent."""
    correct = F.col("intent_correct").cast("int")
    cells = evaluated.groupBy("difficulty", "expected_intent").agg(
        F.count(F.lit(1)).alias("n"), F.sum(correct).alias("ok")
    )
    entries = F.array(
        F.struct(F.lit("difficulty").alias("dimension"), F.col("difficulty").alias("value")),
        F.struct(F.lit("intent").alias("dimension"), F.col("expected_intent").alias("value")),
    )
    total = F.sum("n")
    return (
        cells.select(F.inline(entries), "n", "ok")
        .groupBy("dimension", "value")
        .agg(total.alias("n_questions"), half_even(F.sum("ok") / total * F.lit(100), 1).alias("intent_accuracy"))
    )


def report_tables(evaluated: DataFrame) -> dict[str, DataFrame]:
    """The tables of an evaluation report, for a sink."""
    groups = by_group(evaluated)
    return {
        "summary": summary(evaluated),
        "by_difficulty": groups.filter("dimension = 'difficulty'").drop("dimension"),
        "by_intent": groups.filter("dimension = 'intent'").drop("dimension"),
        "questions": evaluated.drop("expected_tools"),
    }
