"""Cleaning of model output and rule-based labels, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import BLANK, strip

# The two spellings of a reasoning block.
OPENING = f"(?:<{BLANK}*think{BLANK}*>|\U0002DFE8{BLANK}*think{BLANK}*\U0002DFE9)"
CLOSING = f"(?:<{BLANK}*/{BLANK}*think{BLANK}*>|\U0002DFE8{BLANK}*/{BLANK}*think{BLANK}*\U0002DFE9)"
REASONING = f"(?is){OPENING}.*?{CLOSING}"

# Words of the intent rules.
DATA_WORDS = ("check", "find", "show", "query")
ACTION_WORDS = ("create", "open", "task", "if")
CREATE_WORDS = ("create", "open task", "new task", "assign")
PROCEDURE_WORDS = (
    "how to", "procedure", "process", "sop", "threshold", "policy", "should i", "what to do", "handle",
)
METRIC_WORDS = ("show", "list", "top", "rate", "score", "metric", "seller", "order", "delay", "review", "cancel")

NO_EVIDENCE = "NO_EVIDENCE"
PLAN_SCHEMA = (
    "intent string, metric_name string, filters map<string,string>, risk_level_filter string, "
    "need_sql boolean, sql string"
)


def strip_reasoning(text: Column) -> Column:
    """Text without reasoning blocks, trimmed."""
    return strip(F.regexp_replace(text, REASONING, ""))


def is_json(text: Column) -> Column:
    """Whether the whole text is one JSON value.

    The parser stops after the first value and ignores what follows. Text that
    parses both as the only member of an array and of an object has nothing
    left over: what would end one early is an error in the other.
    """
    member = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    value = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return member.isNotNull() & value.isNotNull()


def json_block(text: Column) -> Column:
    """JSON text of the first fenced block, else the widest object or array.

    A candidate that does not parse gives way to the next; NULL if none does.
    """
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    bare = (F.regexp_extract(text, pattern, 0) for pattern in (r"(?s)\{.*\}", r"(?s)\[.*\]"))
    return F.coalesce(*(F.when(is_json(strip(c)), strip(c)) for c in (fenced, *bare)))


def is_refusal(text: Column) -> Column:
    """Whether the cleaned answer says that there is no evidence."""
    return F.upper(strip_reasoning(text)).startswith(NO_EVIDENCE)


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, (F.contains(text, F.lit(w)) for w in words))


def intent_label(question: Column) -> Column:
    """mixed, create_task, sop_qa, metric_query or unknown, first rule wins."""
    q = F.lower(question)
    mixed = (
        (_any(q, DATA_WORDS) & _any(q, ACTION_WORDS))
        | _any(q, ("and then",))
        | (_any(q, ("if",)) & _any(q, ("create",)))
    )
    return (
        F.when(mixed, "mixed")
        .when(_any(q, CREATE_WORDS), "create_task")
        .when(_any(q, PROCEDURE_WORDS), "sop_qa")
        .when(_any(q, METRIC_WORDS), "metric_query")
        .otherwise("unknown")
    )


def normalise_plan(df: DataFrame, output: str, question: str) -> DataFrame:
    """Parse a query plan from model output and fill missing fields.

    Adds a ``plan`` struct; ``plan_error`` tells where no object was found.
    """
    block = json_block(strip_reasoning(F.col(output)))
    rows = df.withColumn("_plan", F.from_json(block, PLAN_SCHEMA)).withColumn("_found", block.startswith("{"))
    plan = F.col("_plan")
    found = F.coalesce("_found", F.lit(False))
    filled = F.struct(
        F.coalesce(plan["intent"], F.col(question)).alias("intent"),
        plan["metric_name"].alias("metric_name"),
        F.coalesce(plan["filters"], F.create_map().cast("map<string,string>")).alias("filters"),
        plan["risk_level_filter"].alias("risk_level_filter"),
        F.coalesce(plan["need_sql"], F.lit(False)).alias("need_sql"),
        plan["sql"].alias("sql"),
    )
    error = F.when(~found, "Failed to extract JSON plan from model output")
    return rows.withColumn("plan", filled).withColumn("plan_error", error).drop("_plan", "_found")
