"""Inspection tasks: validation, numbering, updates, lists and statistics.

A task table is a snapshot; each function returns the next snapshot or a report.
Times are parameters or columns, the clock is never read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import percent, ratio
from ..session import new_path, stored

TASK_SCHEMA = (
    "task_id string, task_type string, priority string, status string, target_id string, title string, "
    "description string, sop_reference string, assignee string, created_at timestamp, updated_at timestamp, "
    "resolved_at timestamp, resolution_note string"
)
TASK_COLUMNS = tuple(part.split()[0] for part in TASK_SCHEMA.split(", "))

# The closed vocabularies and text limits of a task.
TASK_TYPES = ("delivery_risk", "review_triage", "quality_inspection")
PRIORITIES = ("P0", "P1", "P2", "P3")
STATUSES = ("pending", "in_progress", "resolved", "closed", "ignored")
OPEN_STATUSES = ("pending", "in_progress")
DONE_STATUSES = ("resolved", "closed")
CLOSING_STATUSES = ("resolved", "closed", "ignored")
TEXT_LIMITS = {
    "target_id": (1, 128),
    "title": (1, 256),
    "description": (1, 4096),
    "sop_reference": (0, 512),
    "assignee": (0, 128),
}

# Hours until the first response and until resolution, and who
# hears about a task that is late.
SLA_HOURS = {"P0": (4, 24), "P1": (24, 72), "P2": (72, 336)}
ESCALATE_TO = {"P0": "director", "P1": "manager", "P2": "overdue report"}

ID_BUCKETS = 3  # hex digits of the numbering bucket: 4,096 buckets a day


# ------------------------------------------------------ validation, creation


def validate_tasks(candidates: DataFrame) -> DataFrame:
    """Candidates with an ``errors`` array, empty for a valid one."""
    checks = [
        F.when(F.col("task_type").isNull() | ~F.col("task_type").isin(*TASK_TYPES), "invalid task_type"),
        F.when(F.col("priority").isNull() | ~F.col("priority").isin(*PRIORITIES), "invalid priority"),
    ]
    for name, (low, high) in TEXT_LIMITS.items():
        size = F.length(F.coalesce(F.col(name), F.lit("")))
        if low:
            checks.append(F.when(size < low, f"{name} is empty"))
        checks.append(F.when(size > high, f"{name} is longer than {high}"))
    return candidates.withColumn("errors", F.array_compact(F.array(*checks)))


def split_valid(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid candidates without the error column, and rejected ones with it."""
    checked = validate_tasks(candidates)
    good = F.size("errors") == 0
    return checked.filter(good).drop("errors"), checked.filter(~good)


def _day(moment: str = "created_at") -> Column:
    return F.date_format(moment, "yyyyMMdd")


def number_tasks(new: DataFrame, existing: DataFrame | None = None, prefix: str = "RT") -> DataFrame:
    """Add ``PREFIX-YYYYMMDD-NNNN`` ids that continue each day's highest number.

    Numbers are dense per day and follow the md5 of the task's content. A day is
    cut into buckets by that md5: ranks are taken inside a bucket and shifted by
    the sizes of the buckets before it, so no task ever sorts a whole day. Bucket and
    rank depend on the content alone, so a part that is computed again gets the same numbers.
    The new tasks are written once, as ranks and sizes both read them.
    """
    content = F.md5(F.concat_ws("|", "target_id", "task_type", "priority", "title"))
    rows = new.withColumns({"id_day": _day(), "id_hash": content})
    rows = rows.withColumn("id_bucket", F.substring("id_hash", 1, ID_BUCKETS))
    rows = stored(rows, new_path(rows.sparkSession, "unnumbered"))
    in_bucket = Window.partitionBy("id_day", "id_bucket").orderBy("id_hash", "description", "assignee")
    ranked = rows.withColumn("id_rank", F.row_number().over(in_bucket))
    before = Window.partitionBy("id_day").orderBy("id_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        rows.groupBy("id_day", "id_bucket")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("id_day", "id_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("id_shift"))
    )
    numbered = ranked.join(shifts, ["id_day", "id_bucket"])
    number = F.col("id_rank") + F.col("id_shift")
    if existing is not None:
        # A prefix may hold hyphens: day and number are the last two parts.
        parts = F.split("task_id", "-")
        used = (
            existing.filter(F.col("task_id").startswith(f"{prefix}-"))
            .groupBy(F.try_element_at(parts, F.lit(-2)).alias("id_day"))
            .agg(F.max(F.try_element_at(parts, F.lit(-1)).try_cast("long")).alias("id_used"))
        )
        numbered = numbered.join(used, "id_day", "left")
        number = number + F.coalesce("id_used", F.lit(0))
    # at least four digits; longer numbers are kept whole
    digits = F.when(number < 10000, F.lpad(number.cast("string"), 4, "0")).otherwise(number.cast("string"))
    task_id = F.concat_ws("-", F.lit(prefix), "id_day", digits)
    helpers = ("id_day", "id_hash", "id_bucket", "id_rank", "id_shift", "id_used")
    return numbered.withColumn("task_id", task_id).drop(*helpers)


def create_tasks(candidates: DataFrame, existing: DataFrame | None, now: str | Column, prefix: str = "RT") -> DataFrame:
    """The snapshot with the valid candidates added as pending tasks."""
    valid, _ = split_valid(candidates)
    moment = F.lit(now).cast("timestamp") if isinstance(now, str) else now
    fresh = number_tasks(valid.withColumn("created_at", moment), existing, prefix)
    fresh = fresh.select(
        "task_id",
        "task_type",
        "priority",
        F.lit("pending").alias("status"),
        "target_id",
        "title",
        "description",
        F.coalesce("sop_reference", F.lit("")).alias("sop_reference"),
        F.coalesce("assignee", F.lit("")).alias("assignee"),
        "created_at",
        F.col("created_at").alias("updated_at"),
        F.lit(None).cast("timestamp").alias("resolved_at"),
        F.lit("").alias("resolution_note"),
    )
    return fresh if existing is None else existing.select(*TASK_COLUMNS).unionByName(fresh)


# --------------------------------------------------------------------- lists


def get_task(tasks: DataFrame, task_id: str) -> DataFrame:
    return tasks.filter(F.col("task_id") == task_id)


def list_tasks(
    tasks: DataFrame,
    status: str | None = None,
    task_type: str | None = None,
    priority: str | None = None,
    assignee: str | None = None,
    limit: int | None = 20,
) -> DataFrame:
    """Newest tasks with the given values; ``limit=None`` means all."""
    if limit is not None and limit < 1:
        raise ValueError("limit must be at least 1")
    keep = []
    if status:
        keep.append(F.col("status") == status)
    if task_type:
        keep.append(F.col("task_type") == task_type)
    if priority:
        keep.append(F.col("priority") == priority)
    if assignee:
        keep.append(F.contains(F.lower("assignee"), F.lit(assignee.lower())))
    rows = reduce(DataFrame.filter, keep, tasks).orderBy(F.desc("created_at"), F.desc("task_id"))
    return rows if limit is None else rows.limit(limit)


def open_tasks(tasks: DataFrame) -> DataFrame:
    """All open tasks, the most urgent first, oldest first among equals."""
    rank = F.array_position(F.array(*map(F.lit, PRIORITIES)), F.col("priority"))
    last = F.when(F.coalesce(rank, F.lit(0)) == 0, 99).otherwise(rank)
    return tasks.filter(F.col("status").isin(*OPEN_STATUSES)).orderBy(last, "created_at", "task_id")


# ------------------------------------------------------------------- updates


def apply_updates(tasks: DataFrame, updates: DataFrame) -> DataFrame:
    """The snapshot after status updates, applied in the order of their time.

    ``updates`` has task_id, status, resolution_note, assignee and updated_at.
    They are reduced to one row per task first: the last status, the last
    non-empty note, the last given assignee and the last time of being done.
    Updates with a status outside the vocabulary or an unknown task do nothing.
    Updates of one moment apply in the order of the column ``sequence``, if there
    is one, then of their content; those without a time come before all others.
    """
    at = F.col("updated_at")
    order = F.struct(at, *(c for c in ("sequence",) if c in updates.columns), "status", "resolution_note", "assignee")
    latest = (
        updates.filter(F.col("status").isin(*STATUSES))
        .groupBy("task_id")
        .agg(
            F.max_by("status", order).alias("new_status"),
            F.max(at).alias("new_updated_at"),
            F.max(F.when(F.col("status").isin(*DONE_STATUSES), at)).alias("new_resolved_at"),
            F.max_by("resolution_note", F.when(F.col("resolution_note") != "", order)).alias("new_note"),
            F.max_by("assignee", F.when(F.col("assignee").isNotNull(), order)).alias("new_assignee"),
        )
    )
    changed = {
        "status": F.coalesce("new_status", "status"),
        "updated_at": F.coalesce("new_updated_at", "updated_at"),
        "resolved_at": F.coalesce("new_resolved_at", "resolved_at"),
        "resolution_note": F.coalesce("new_note", "resolution_note"),
        "assignee": F.coalesce("new_assignee", "assignee"),
    }
    return tasks.join(latest, "task_id", "left").withColumns(changed).select(*tasks.columns)


def close_tasks(tasks: DataFrame, requests: DataFrame) -> DataFrame:
    """Apply closing requests; a missing status means resolved.

    Only resolved, closed and ignored are accepted, others are left out.
    """
    status = F.coalesce("status", F.lit("resolved"))
    wanted = requests.withColumn("status", status).filter(status.isin(*CLOSING_STATUSES))
    return apply_updates(tasks, wanted)


def update_report(tasks: DataFrame, updates: DataFrame, allowed: tuple[str, ...] = STATUSES) -> DataFrame:
    """What happens to each update: ``updated``, ``not found`` or ``invalid status``."""
    known = tasks.select("task_id", F.lit(True).alias("is_known"))
    outcome = (
        F.when(F.col("status").isNull() | ~F.col("status").isin(*allowed), "invalid status")
        .when(F.col("is_known").isNull(), "not found")
        .otherwise("updated")
    )
    return updates.join(known, "task_id", "left").withColumn("outcome", outcome).drop("is_known")


def auto_close(tasks: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Close tasks that have been resolved for ``days`` days."""
    now = F.lit(as_of).cast("timestamp")
    due = (F.col("status") == "resolved") & (F.col("resolved_at") <= now - F.make_dt_interval(F.lit(days)))
    due = F.coalesce(due, F.lit(False))
    # updated_at first: it still has to see the old status
    return tasks.withColumn("updated_at", F.when(due, now).otherwise(F.col("updated_at"))).withColumn(
        "status", F.when(due, "closed").otherwise(F.col("status"))
    )


# ---------------------------------------------------------------- statistics


def task_stats(tasks: DataFrame) -> DataFrame:
    """Counts by status, type and priority, and the total.

    One pass reduces the tasks to the few combinations of the three columns;
    the roll-ups are taken from those.
    """
    dimensions = ("status", "task_type", "priority")
    combos = tasks.groupBy(*dimensions).agg(F.count(F.lit(1)).alias("n"))
    entries = [F.struct(F.lit(d).alias("dimension"), F.coalesce(d, F.lit("unknown")).alias("value")) for d in dimensions]
    entries.append(F.struct(F.lit("total").alias("dimension"), F.lit("all").alias("value")))
    return (
        combos.select(F.inline(F.array(*entries)), "n")
        .groupBy("dimension", "value")
        .agg(F.sum("n").alias("n_tasks"))
    )


def deduplicate(candidates: DataFrame, keys: tuple[str, ...] = ("target_kind", "target_id", "cycle")) -> DataFrame:
    """One candidate per target and cycle; its other findings become sub-items.

    The most urgent candidate stays. Sub-items are distinct (priority, type)
    pairs, so their array has at most twelve entries however many rows a target
    has.
    """
    rest = [c for c in candidates.columns if c not in keys and c not in ("priority", "task_type")]
    head = F.struct("priority", "task_type", *rest)
    pair = F.concat_ws(":", "priority", "task_type")
    kept = candidates.groupBy(*keys).agg(
        F.min(head).alias("head"),
        F.count(F.lit(1)).alias("n_candidates"),
        F.collect_set(pair).alias("pairs"),
    )
    own = F.concat_ws(":", "head.priority", "head.task_type")
    return kept.select(
        *keys,
        "head.*",
        "n_candidates",
        F.array_sort(F.array_remove("pairs", own)).alias("sub_items"),
    )


def _limit_hours(position: int) -> Column:
    hours = F.lit(None).cast("int")
    for priority, limits in SLA_HOURS.items():
        hours = F.when(F.col("priority") == priority, limits[position]).otherwise(hours)
    return hours


def _after(moment: Column, hours: Column) -> Column:
    return moment + F.make_dt_interval(F.lit(0), hours)


def sla_state(tasks: DataFrame, as_of: str) -> DataFrame:
    """Due times, breaches and escalation of every task at ``as_of``.

    A task counts as answered once it left the pending status; the store keeps
    the time of its last change.
    """
    now = F.lit(as_of).cast("timestamp")
    created = F.col("created_at")
    answered = F.when(F.col("status") != "pending", F.col("updated_at"))
    respond_by, resolve_by = _after(created, _limit_hours(0)), _after(created, _limit_hours(1))
    target = F.lit(None).cast("string")
    for priority, who in ESCALATE_TO.items():
        target = F.when(F.col("priority") == priority, who).otherwise(target)
    unresolved = F.col("resolved_at").isNull() & (F.col("status") != "ignored")
    late = F.coalesce(F.coalesce(F.col("resolved_at"), now) > resolve_by, F.lit(False))
    late = late & (F.col("status") != "ignored")
    return tasks.withColumns(
        {
            "respond_by": respond_by,
            "resolve_by": resolve_by,
            "response_breach": F.coalesce(F.coalesce(answered, now) > respond_by, F.lit(False)),
            "resolve_breach": late,
            "escalate_to": F.when(late & unresolved, target),
        }
    )


def task_month_stats(tasks: DataFrame, as_of: str) -> DataFrame:
    """Created, resolved in time, resolve hours and escalations per month."""
    rows = sla_state(tasks, as_of).withColumn("month", F.trunc("created_at", "month"))
    seconds = F.unix_seconds("resolved_at") - F.unix_seconds("created_at")
    in_time = F.col("resolved_at").isNotNull() & ~F.col("resolve_breach")
    escalated = F.col("priority").isin("P0", "P1") & F.col("escalate_to").isNotNull()
    created = F.count(F.lit(1))
    return rows.groupBy("month", "task_type", "priority").agg(
        created.alias("n_created"),
        F.count("resolved_at").alias("n_resolved"),
        percent(F.count_if(in_time), created).alias("in_sla_pct"),
        (ratio(F.sum(seconds), F.count(seconds)) / 3600.0).alias("avg_resolve_hours"),
        percent(F.count_if(escalated), created).alias("escalated_pct"),
    )


def task_recurrence(tasks: DataFrame, days: int = 30) -> DataFrame:
    """Share of tasks that repeat one of the same target and type within ``days``.

    Tasks are first reduced to distinct moments per target and type. Moments are
    compared inside time slices of ``days`` days; the first moment of a slice
    looks at the last one of the slice before. No window spans a target's whole
    history.
    """
    keys = ["target_id", "task_type"]
    moments = tasks.groupBy(*keys, "created_at").agg(F.count(F.lit(1)).alias("n"))
    moments = moments.withColumn("slice", F.floor(F.unix_seconds("created_at") / (days * 86400)))
    in_slice = Window.partitionBy(*keys, "slice").orderBy("created_at")
    last = moments.groupBy(*keys, (F.col("slice") + 1).alias("slice")).agg(F.max("created_at").alias("last_before"))
    previous = F.coalesce(F.lag("created_at").over(in_slice), F.col("last_before"))
    rows = moments.join(last, [*keys, "slice"], "left").withColumn("previous", previous)
    gap = F.unix_seconds("created_at") - F.unix_seconds("previous")
    repeats = F.when(gap <= days * 86400, F.col("n")).otherwise(F.col("n") - 1)
    created, repeated = F.sum("n"), F.sum(repeats)
    return rows.groupBy(F.trunc("created_at", "month").alias("month"), "task_type").agg(
        created.alias("n_created"),
        repeated.alias("n_repeated"),
        percent(repeated, created).alias("recurrence_pct"),
    )


# --------------------------------------------------------- tasks from findings


def tasks_from_findings(
    requests: DataFrame, findings: DataFrame, max_findings: int | None = 3, finding_chars: int | None = 300
) -> DataFrame:
    """Type, priority, target, gate and texts of a task per request.

    ``requests`` has request_id, request and context_chars (0 when there is no
    procedure context); with a column ``plan`` its text counts for the type, too.
    ``findings`` has request_id, position (from 0), seller_id, product_id, order_id,
    risk_level and finding (JSON text). A request's findings are reduced by partial
    aggregates; the description shows the first ``max_findings`` up to
    ``finding_chars`` characters each (None: all), and may then be longer than a
    task allows: ``validate_tasks`` tells.
    """
    at = F.col("position")
    level = F.when(F.col("risk_level").isin(*PRIORITIES), F.col("risk_level"))
    target = F.coalesce(*(F.col(c).cast("string") for c in ("seller_id", "product_id", "order_id")))
    line = F.concat(F.lit("  - "), F.col("finding") if finding_chars is None else F.substring("finding", 1, finding_chars))
    shown = F.lit(True) if max_findings is None else at < max_findings
    reduced = findings.groupBy("request_id").agg(
        F.min_by(level, F.when(level.isNotNull(), at)).alias("first_level"),
        F.min_by(target, F.when(target.isNotNull(), at)).alias("first_target"),
        F.bool_or(F.col("risk_level").isin("P0", "P1")).alias("any_urgent"),
        F.array_sort(F.collect_list(F.when(shown, F.struct(at, line.alias("line"))))).alias("lines"),
    )
    text = F.lower("request")
    planned = F.concat_ws(" ", text, *(F.lower(c) for c in ("plan",) if c in requests.columns))

    def says(*words: str, where: Column = text) -> Column:
        return reduce(Column.__or__, (F.contains(where, F.lit(w)) for w in words))

    named = F.coalesce(*(F.when(says(p.lower()), p) for p in PRIORITIES))
    task_type = (
        F.when(says("review", "triage", where=planned), "review_triage")
        .when(says("quality", "product", "defect", where=planned), "quality_inspection")
        .otherwise("delivery_risk")
    )
    priority = F.coalesce(named, "first_level", F.lit("P2"))
    target_id = F.coalesce("first_target", F.lit("unknown_target"))
    lines = F.transform("lines", lambda entry: entry["line"])
    listed = F.when(F.size("lines") > 0, F.concat(F.lit("Metric findings:\n"), F.array_join(lines, "\n")))
    context = F.when(
        F.col("context_chars") > 0,
        F.concat(F.lit("SOP context available ("), F.col("context_chars").cast("string"), F.lit(" chars)")),
    )
    opening = F.concat(F.lit("Auto-generated from query: "), "request")
    return requests.join(reduced, "request_id", "left").select(
        "request_id",
        task_type.alias("task_type"),
        priority.alias("priority"),
        target_id.alias("target_id"),
        F.concat(F.lit("["), priority, F.lit("] Inspection for "), target_id).alias("title"),
        F.concat_ws("\n", opening, listed, context).alias("description"),
        (says("create", "task", "open") | F.coalesce("any_urgent", F.lit(False))).alias("should_create"),
    )
