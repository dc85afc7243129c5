"""Model-output cleaning, intent labels and evaluation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation, labelling, marts, retrieval
from ..operators.tasks import TEXT_LIMITS
from ..sources.star import load_star, read_table
from .base import nearest, query_sql
from .documents import DOCUMENT_CHUNKS, recursive
from .retrieval import _FOUND, _HITS, TOP_K, search_index, search_views

OPENINGS = (
    "Show the sellers and create a task",
    "Create an inspection for",
    "How to handle this: ",
    "List the review scores of",
    "Tell me about",
    "Find delays, if any",
    "What is the policy on",
)
INTENTS = ("metric_query", "sop_qa", "create_task", "mixed", "unknown")
LEVELS = ("easy", "medium", "hard")
TOOLS = (("get_top_risky_sellers",), ("get_seller_profile", "create_inspection_task"), ("create_inspection_task",), ())


def _pick(values: tuple, number: Column) -> Column:
    def literal(value: object) -> Column:
        if isinstance(value, tuple):
            return F.array(*map(F.lit, value)).cast("array<string>")
        return F.lit(value)

    return F.element_at(F.array(*map(literal, values)), (number % len(values) + 1).cast("int"))


def outputs(spark: SparkSession, folder: str) -> DataFrame:
    """Every turn as model output: reasoning, then a fence, prose or bare JSON."""
    number = F.col("conv_id") + F.col("turn")
    good = F.format_string('{"intent": "turn %d", "need_sql": %s}', "turn", F.when(number % 2 == 0, "true").otherwise("false"))
    body = (
        F.when(number % 4 == 0, F.concat(F.lit("Answer:\n```json\n"), good, F.lit("\n```\nDone.")))
        .when(number % 4 == 1, F.concat(F.lit("```json\n{broken\n``` but then "), good, F.lit(" follows")))
        .when(number % 4 == 2, F.format_string("values [%d, %d] only", "conv_id", "turn"))
        .otherwise(F.concat(F.lit("no_evidence: "), "text"))
    )
    opening = F.when(number % 3 == 0, "<think>").otherwise("< THINK >")
    text = F.concat(F.lit("  "), opening, "text", F.lit("</think>\n"), body, F.lit(" "))
    return read_table(spark, folder, "conversations").select("conv_id", "turn", F.col("text"), text.alias("output"))


def strip_reasoning(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = labelling.strip_reasoning(F.col("output"))
    return outputs(spark, folder).select("conv_id", "turn", cleaned.alias("cleaned"))


def json_block(spark: SparkSession, folder: str) -> DataFrame:
    found = labelling.json_block(labelling.strip_reasoning(F.col("output")))
    refused = labelling.is_refusal(F.col("output"))
    return outputs(spark, folder).select("conv_id", "turn", found.alias("json"), refused.alias("refused"))


def plan_fields(spark: SparkSession, folder: str) -> DataFrame:
    rows = labelling.normalise_plan(outputs(spark, folder), "output", "text")
    return rows.select(
        "conv_id", "turn", F.col("plan.intent").alias("intent"), F.col("plan.need_sql").alias("need_sql"),
        F.size("plan.filters").alias("n_filters"), "plan_error",
    )


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """Every turn as a question with an opening that asks for something."""
    conv, turn = F.col("conv_id"), F.col("turn")
    return read_table(spark, folder, "conversations").select(
        F.concat_ws("-", conv.cast("string"), turn.cast("string")).alias("id"),
        F.concat_ws(" ", _pick(OPENINGS, conv + turn), "text").alias("question"),
        _pick(INTENTS, conv).alias("expected_intent"),
        F.lit(None).cast("string").alias("relevant_sop"),
        _pick(TOOLS, turn).alias("expected_tools"),
        _pick(LEVELS, conv + turn * 7).alias("difficulty"),
    )


def intent_labels(spark: SparkSession, folder: str) -> DataFrame:
    return questions(spark, folder).select("id", labelling.intent_label(F.col("question")).alias("intent"))


def eval_by_group(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.by_group(evaluation.evaluate(questions(spark, folder), F.lit(True), F.lit(True)))


def eval_summary(spark: SparkSession, folder: str) -> DataFrame:
    """All four rates over the benchmark passages as questions."""
    number = F.col("item_id")
    asked = read_table(spark, folder, "benchmark").select(
        number.cast("string").alias("id"),
        F.concat_ws(" ", _pick(OPENINGS, number), "text").alias("question"),
        _pick(INTENTS, number).alias("expected_intent"),
        F.when(number % 3 != 0, F.concat(F.lit("SRC"), (number % 20).cast("string"))).alias("relevant_sop"),
        _pick(TOOLS, number).alias("expected_tools"),
        _pick(LEVELS, number).alias("difficulty"),
        F.col("text"),
    )
    found = retrieval.retrieve(
        search_index(spark, folder), asked.select(F.col("id").alias("query_id"), F.col("text").alias("query")), TOP_K
    )
    # a question asks for the metrics of one seller, and not every number is a seller's
    sellers = marts.seller_delivery_metrics(load_star(spark, folder)).select((F.col("seller_id")).alias("asked_seller"), F.lit(True).alias("known"))
    asked = asked.withColumn("asked_seller", F.col("id").cast("long") * 3).join(sellers, "asked_seller", "left").drop("asked_seller")
    metric_ok = F.coalesce("known", F.lit(False))
    low, high = TEXT_LIMITS["title"]
    task_ok = F.length("question").between(low, high)
    rows = evaluation.evaluate(asked.drop("text"), metric_ok, task_ok, evaluation.source_hits(asked, found))
    return evaluation.summary(rows)


QUERIES = {
    f.__name__: f
    for f in (strip_reasoning, json_block, plan_fields, intent_labels, eval_by_group, eval_summary)
}

# ------------------------------------------------------------------ SQL twins

_OUTPUT = r"""
    SELECT conv_id, turn, text, '  ' || CASE WHEN n % 3 = 0 THEN '<think>' ELSE '< THINK >' END || text || '</think>' || chr(10) ||
           CASE n % 4 WHEN 0 THEN 'Answer:' || chr(10) || '```json' || chr(10) || good || chr(10) || '```' || chr(10) || 'Done.'
                      WHEN 1 THEN '```json' || chr(10) || '{broken' || chr(10) || '``` but then ' || good || ' follows'
                      WHEN 2 THEN 'values [' || conv_id || ', ' || turn || '] only'
                      ELSE 'no_evidence: ' || text END || ' ' AS output
    FROM (SELECT *, conv_id + turn AS n,
                 '{"intent": "turn ' || turn || '", "need_sql": ' || CASE WHEN n % 2 = 0 THEN 'true' ELSE 'false' END || '}' AS good
          FROM conversations)"""
_CLEAN = r"""
    SELECT *, regexp_replace(regexp_replace(output, '(?is)<\s*think\s*>.*?<\s*/\s*think\s*>', '', 'g'), '^\s+|\s+$', '', 'g') AS cleaned
    FROM outputs"""
_JSON = r"""
    SELECT *, CASE WHEN json_valid(fence) THEN fence WHEN json_valid(object) THEN object WHEN json_valid(list) THEN list END AS json
    FROM (SELECT *, trim(regexp_extract(cleaned, '(?s)```(?:json)?\s*(.*?)```', 1), ' ' || chr(10)) AS fence,
                 regexp_extract(cleaned, '(?s)\{.*\}') AS object, regexp_extract(cleaned, '(?s)\[.*\]') AS list
          FROM clean)"""


def _list(values: tuple) -> str:
    return "[" + ", ".join("[" + ", ".join(f"'{x}'" for x in v) + "]" if isinstance(v, tuple) else f"'{v}'" for v in values) + "]"


def _label(question: str) -> str:
    def has(words: tuple[str, ...]) -> str:
        return f"regexp_matches(lower({question}), '{'|'.join(words)}')"

    return f"""CASE WHEN ({has(labelling.DATA_WORDS)} AND {has(labelling.ACTION_WORDS)}) OR {has(("and then",))}
                         OR ({has(("if",))} AND {has(("create",))}) THEN 'mixed'
                    WHEN {has(labelling.CREATE_WORDS)} THEN 'create_task' WHEN {has(labelling.PROCEDURE_WORDS)} THEN 'sop_qa'
                    WHEN {has(labelling.METRIC_WORDS)} THEN 'metric_query' ELSE 'unknown' END"""


_ASKED = f"""
    SELECT conv_id || '-' || turn AS id, {_list(OPENINGS)}[(conv_id + turn) % {len(OPENINGS)} + 1] || ' ' || text AS question,
           {_list(INTENTS)}[conv_id % {len(INTENTS)} + 1] AS expected, {_list(LEVELS)}[(conv_id + turn * 7) % 3 + 1] AS difficulty
    FROM conversations"""


def _rate(ok: str, scope: str) -> str:
    share = f"avg(CAST(({ok}) AS INTEGER)) FILTER ({scope}) * 100"
    return f"coalesce({nearest(share, 1)}, 100)"


ORACLES = {
    "strip_reasoning": query_sql("SELECT conv_id, turn, cleaned FROM clean", outputs=_OUTPUT, clean=_CLEAN),
    "json_block": query_sql(
        "SELECT conv_id, turn, json, starts_with(upper(cleaned), 'NO_EVIDENCE') AS refused FROM blocks",
        outputs=_OUTPUT, clean=_CLEAN, blocks=_JSON,
    ),
    "plan_fields": query_sql(
        """SELECT conv_id, turn, CASE WHEN found THEN coalesce(json ->> '$.intent', text) ELSE text END AS intent,
                  CASE WHEN found THEN json ->> '$.need_sql' = 'true' ELSE false END AS need_sql, 0 AS n_filters,
                  CASE WHEN NOT found THEN 'Failed to extract JSON plan from model output' END AS plan_error
           FROM (SELECT *, coalesce(starts_with(json, '{'), false) AS found FROM blocks)""",
        outputs=_OUTPUT, clean=_CLEAN, blocks=_JSON,
    ),
    "intent_labels": query_sql(f"SELECT id, {_label('question')} AS intent FROM asked_turns", asked_turns=_ASKED),
    "eval_by_group": query_sql(
        f"""SELECT CASE WHEN difficulty IS NULL THEN 'intent' ELSE 'difficulty' END AS dimension,
                  coalesce(difficulty, expected) AS value, count(*) AS n_questions,
                  {nearest("sum(CAST(ok AS INTEGER)) / count(*) * 100", 1)} AS intent_accuracy
           FROM labelled GROUP BY GROUPING SETS ((difficulty), (expected))""",
        asked_turns=_ASKED,
        labelled=f"SELECT *, {_label('question')} = expected AS ok FROM asked_turns",
    ),
    "eval_summary": recursive(
        f"""SELECT count(*) AS n_questions, {_rate("label = expected", "true")} AS intent_accuracy,
                   {_rate("known OR item_id % 4 IN (2, 3)", "expected IN ('metric_query', 'mixed')")} AS metric_success,
                   {_rate("hit", "item_id % 3 <> 0")} AS source_hit_rate,
                   {_rate("length(question) BETWEEN 1 AND 256", "item_id % 4 IN (1, 2)")} AS task_success
            FROM (SELECT *, {_label("question")} AS label FROM (
                SELECT item_id, {_list(OPENINGS)}[item_id % {len(OPENINGS)} + 1] || ' ' || text AS question,
                       {_list(INTENTS)}[item_id % {len(INTENTS)} + 1] AS expected, hit,
                       item_id * 3 IN (SELECT seller_id FROM m_shipped) AS known
                FROM benchmark JOIN verdicts USING (item_id)))""",
        **DOCUMENT_CHUNKS, **search_views("doc_chunks", 3 * TOP_K), found=_FOUND, verdicts=_HITS,
    ),
}
