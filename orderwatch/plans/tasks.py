"""Inspection tasks built from the automatic rules over all months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import policy, tasks
from ..session import new_path, stored
from ..sources.star import load_star
from .base import clock, nearest, query_sql, rounded, share
from .policy import TASK_VIEWS, candidates, seller_months

AS_OF = "2001-08-02 12:00:00"
TIMES = ("created_at", "updated_at", "resolved_at", "respond_by", "resolve_by")

REQUESTS = (
    "Review triage for this seller",
    "Create P1 quality task",
    "Show delay findings",
    "open a product inspection, p0",
    "Check deliveries",
    "defect report",
)


def _number() -> Column:
    return F.col("target_id").cast("long")


def _hours(moment: Column, hours: Column) -> Column:
    return moment + F.make_dt_interval(F.lit(0), hours.cast("int"))


def created(spark: SparkSession, folder: str) -> DataFrame:
    """Every candidate as a pending task, created at the end of its month."""
    month_end = F.last_day("cycle").cast("timestamp")
    return tasks.create_tasks(candidates(spark, folder), None, month_end)


def worked(spark: SparkSession, folder: str) -> DataFrame:
    """The same tasks at some stage of their work, by target number."""
    n, born = _number(), F.col("created_at")
    status = (
        F.when(n % 12 == 0, "in_progress")
        .when(n % 6 == 0, "pending")
        .when(n % 5 == 0, "closed")
        .when(n % 7 == 0, "ignored")
        .otherwise("resolved")
    )
    solved = F.when(status.isin("closed", "resolved"), _hours(born, n * 7 % 40))
    begun = F.when(status == "in_progress", _hours(born, n % 100))
    return created(spark, folder).withColumns(
        {"status": status, "resolved_at": solved, "updated_at": F.coalesce(solved, begun, born)}
    )


def _shown(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*(clock(c) if c in TIMES else c for c in columns or df.columns))


def updates(base: DataFrame) -> DataFrame:
    """Three updates per task; the last one names an unknown task."""
    n, born = _number(), F.col("created_at")
    later = F.element_at(
        F.array(*map(F.lit, ("in_progress", "resolved", "closed", "ignored", "bogus"))), (n % 5 + 1).cast("int")
    )

    def update(task_id: Column, status: Column, note: Column, who: Column, hours: Column) -> Column:
        return F.struct(
            task_id.alias("task_id"), status.alias("status"), note.alias("resolution_note"), who.alias("assignee"),
            _hours(born, hours).alias("updated_at"),
        )

    none = F.lit(None).cast("string")
    entries = F.array(
        update(F.col("task_id"), F.lit("in_progress"), F.lit("seen"), F.lit("desk"), F.lit(1)),
        update(F.col("task_id"), later, F.when(n % 2 == 0, "done").otherwise(""), F.when(n % 3 == 0, "lead"), n % 9 + 2),
        update(F.concat("task_id", F.lit("-x")), F.lit("closed"), F.lit(""), none, F.lit(3)),
    )
    return base.select(F.inline(entries))


def task_creation(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(created(spark, folder), "task_id", "task_type", "priority", "status", "target_id", "title", "created_at")


def task_numbering_continued(spark: SparkSession, folder: str) -> DataFrame:
    """A second batch on the same days goes on from the first one's numbers."""
    first = created(spark, folder)
    again = tasks.number_tasks(first.drop("task_id").withColumn("title", F.concat("title", F.lit(" (2)"))), first)
    return _shown(again, "task_id", "title", "created_at")


def task_validation(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates, some of them spoilt by target number."""
    n = _number()
    spoilt = candidates(spark, folder).withColumns(
        {
            "priority": F.when(n % 11 == 0, "P9").otherwise(F.col("priority")),
            "title": F.when(n % 13 == 0, "").otherwise(F.col("title")),
            "assignee": F.when(n % 17 == 0, F.repeat("assignee", F.lit(40))).otherwise(F.col("assignee")),
        }
    )
    checked = tasks.validate_tasks(spoilt)
    return checked.select("target_kind", "target_id", "cycle", "task_type", F.array_join("errors", "; ").alias("errors"))


def task_list(spark: SparkSession, folder: str) -> DataFrame:
    rows = tasks.list_tasks(worked(spark, folder), "resolved", "delivery_risk", "P1", "专员", limit=50)
    return _shown(rows, "task_id", "target_id", "title", "created_at")


def task_list_open(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(tasks.open_tasks(worked(spark, folder)), "task_id", "priority", "status", "target_id", "created_at")


def task_updates(spark: SparkSession, folder: str) -> DataFrame:
    base = created(spark, folder)
    rows = tasks.apply_updates(base, updates(base))
    return _shown(rows, "task_id", "status", "assignee", "updated_at", "resolved_at", "resolution_note")


def task_update_report(spark: SparkSession, folder: str) -> DataFrame:
    base = stored(created(spark, folder), new_path(spark, "tasks"))
    rows = tasks.update_report(base, updates(base))
    return rows.groupBy("status", "outcome").agg(F.count(F.lit(1)).alias("n_updates"))


def task_close(spark: SparkSession, folder: str) -> DataFrame:
    n, born = _number(), F.col("created_at")
    status = F.when(n % 4 == 1, "closed").when(n % 4 == 2, "ignored").when(n % 4 == 3, "pending")
    base = created(spark, folder)
    requests = base.select(
        "task_id", status.alias("status"), F.lit("closed by desk").alias("resolution_note"),
        F.lit(None).cast("string").alias("assignee"), _hours(born, n % 20).alias("updated_at"),
    )
    rows = tasks.close_tasks(base, requests)
    return _shown(rows, "task_id", "status", "updated_at", "resolved_at", "resolution_note")


def task_stats(spark: SparkSession, folder: str) -> DataFrame:
    return tasks.task_stats(worked(spark, folder))


def sla_breaches(spark: SparkSession, folder: str) -> DataFrame:
    rows = tasks.sla_state(worked(spark, folder), AS_OF).filter("response_breach or resolve_breach")
    return _shown(
        rows, "task_id", "priority", "status", "respond_by", "resolve_by", "response_breach", "resolve_breach", "escalate_to"
    )


def auto_close(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(tasks.auto_close(worked(spark, folder), AS_OF), "task_id", "status", "updated_at", "resolved_at")


def task_month_stats(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(tasks.task_month_stats(worked(spark, folder), AS_OF), 6, "avg_resolve_hours")


def task_recurrence(spark: SparkSession, folder: str) -> DataFrame:
    return tasks.task_recurrence(worked(spark, folder))


def _requests(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """One request per seller; its findings are the seller's months."""
    n = F.col("seller_id")
    requests = load_star(spark, folder)["sellers"].select(
        F.col("seller_id").alias("request_id"),
        F.element_at(F.array(*map(F.lit, REQUESTS)), (n % len(REQUESTS) + 1).cast("int")).alias("request"),
        (n % 3 * 100).alias("context_chars"),
    )
    level = policy.delivery_tier()
    months = Window.partitionBy("seller_id").orderBy("period")
    text = F.struct(
        n.cast("string").alias("seller_id"), F.date_format("period", "yyyy-MM").alias("month"), level.alias("risk_level")
    )
    findings = seller_months(spark, folder).select(
        F.col("seller_id").alias("request_id"),
        (F.row_number().over(months) - 1).alias("position"),
        F.when(n % 4 != 0, n).alias("seller_id"),
        F.lit(None).cast("long").alias("product_id"),
        F.when(n % 8 == 0, n * 10).alias("order_id"),
        level.alias("risk_level"),
        F.to_json(text).alias("finding"),
    )
    return requests, findings


def tasks_from_findings(spark: SparkSession, folder: str) -> DataFrame:
    return tasks.tasks_from_findings(*_requests(spark, folder))


def tasks_from_whole_findings(spark: SparkSession, folder: str) -> DataFrame:
    """All findings whole; the plan names a topic that the request may not name."""
    requests, findings = _requests(spark, folder)
    n = F.col("request_id")
    plan = F.when(n % 5 == 0, "Metric: DEFECT rate").when(n % 5 == 1, "negative reviews").when(n % 5 == 2, "late")
    return tasks.tasks_from_findings(requests.withColumn("plan", plan), findings, max_findings=None, finding_chars=None)


QUERIES = {
    f.__name__: f
    for f in (
        task_creation, task_numbering_continued, task_validation, task_list, task_list_open, task_updates,
        task_update_report, task_close, task_stats, sla_breaches, auto_close, task_month_stats, task_recurrence,
        tasks_from_findings, tasks_from_whole_findings,
    )
}

# ------------------------------------------------------------------ SQL twins


def _text(column: str, name: str | None = None) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S') AS {name or column}"


_BORN = """
    SELECT *, CAST(last_day(cycle) AS TIMESTAMP) AS created_at, CAST(target_id AS BIGINT) AS n,
           'RT-' || strftime(last_day(cycle), '%Y%m%d') || '-' ||
           format('{:04d}', row_number() OVER (PARTITION BY last_day(cycle)
               ORDER BY md5(concat_ws('|', target_id, task_type, priority, title)), description, assignee)) AS task_id
    FROM fired"""
_WORKED = """
    SELECT *, coalesce(resolved_at, CASE WHEN status = 'in_progress' THEN created_at + to_hours(n % 100) END, created_at)
                  AS updated_at
    FROM (SELECT *, CASE WHEN status IN ('closed', 'resolved') THEN created_at + to_hours(n * 7 % 40) END AS resolved_at
          FROM (SELECT *, CASE WHEN n % 12 = 0 THEN 'in_progress' WHEN n % 6 = 0 THEN 'pending' WHEN n % 5 = 0 THEN 'closed'
                               WHEN n % 7 = 0 THEN 'ignored' ELSE 'resolved' END AS status FROM born))"""
_UPDATES = """
    SELECT task_id, 'in_progress' AS status, 'seen' AS note, 'desk' AS who, created_at + INTERVAL 1 HOUR AS moment FROM born
    UNION ALL
    SELECT task_id, ['in_progress', 'resolved', 'closed', 'ignored', 'bogus'][n % 5 + 1],
           CASE WHEN n % 2 = 0 THEN 'done' ELSE '' END, CASE WHEN n % 3 = 0 THEN 'lead' END,
           created_at + to_hours(n % 9 + 2) FROM born
    UNION ALL SELECT task_id || '-x', 'closed', '', NULL, created_at + INTERVAL 3 HOUR FROM born"""
_NOW = f"TIMESTAMP '{AS_OF}'"
_SLA = f"""
    SELECT *, CASE WHEN status <> 'ignored' THEN coalesce(coalesce(resolved_at, {_NOW}) > resolve_by, false)
                   ELSE false END AS resolve_breach,
           coalesce(CASE WHEN status = 'pending' THEN {_NOW} ELSE updated_at END > respond_by, false) AS response_breach
    FROM (SELECT *, created_at + to_hours(CASE priority WHEN 'P0' THEN 4 WHEN 'P1' THEN 24 WHEN 'P2' THEN 72 END) AS respond_by,
                 created_at + to_hours(CASE priority WHEN 'P0' THEN 24 WHEN 'P1' THEN 72 WHEN 'P2' THEN 336 END) AS resolve_by
          FROM worked)"""
_ESCALATE = """CASE WHEN resolve_breach AND resolved_at IS NULL
                    THEN CASE priority WHEN 'P0' THEN 'director' WHEN 'P1' THEN 'manager' ELSE 'overdue report' END END"""


def _over_tasks(body: str, **extra: str) -> str:
    return query_sql(body, **TASK_VIEWS, born=_BORN, worked=_WORKED, **extra)


def _findings(topic: str, shown: str) -> str:
    """Tasks of the requests: type by the text ``topic``, description from the findings ``shown``."""
    return query_sql(
        f"""SELECT request_id,
                  CASE WHEN regexp_matches({topic}, 'review|triage') THEN 'review_triage'
                       WHEN regexp_matches({topic}, 'quality|product|defect') THEN 'quality_inspection' ELSE 'delivery_risk' END AS task_type,
                  CASE WHEN contains(q, 'p0') THEN 'P0' WHEN contains(q, 'p1') THEN 'P1' ELSE coalesce(first_level, 'P2') END AS priority,
                  target AS target_id, format('[{{}}] Inspection for {{}}', priority, target) AS title,
                  concat_ws(chr(10), 'Auto-generated from query: ' || request, 'Metric findings:' || chr(10) || lines,
                            CASE WHEN context_chars > 0 THEN format('SOP context available ({{}} chars)', context_chars) END) AS description,
                  regexp_matches(q, 'create|task|open') OR coalesce(urgent, false) AS should_create
           FROM (SELECT s.seller_id AS request_id, ['Review triage for this seller', 'Create P1 quality task',
                        'Show delay findings', 'open a product inspection, p0', 'Check deliveries', 'defect report'][s.seller_id % 6 + 1] AS request,
                        lower(request) AS q, s.seller_id % 3 * 100 AS context_chars, first_level, urgent, lines,
                        CASE WHEN n > 0 AND s.seller_id % 4 <> 0 THEN CAST(s.seller_id AS VARCHAR)
                             WHEN n > 0 AND s.seller_id % 8 = 0 THEN CAST(s.seller_id * 10 AS VARCHAR) ELSE 'unknown_target' END AS target
                 FROM m_sellers s LEFT JOIN (
                     SELECT seller_id, count(*) AS n, arg_min(level, place) AS first_level, bool_or(level IN ('P0', 'P1')) AS urgent,
                            string_agg('  - ' || finding, chr(10) ORDER BY place) FILTER ({shown}) AS lines
                     FROM (SELECT *, row_number() OVER (PARTITION BY seller_id ORDER BY month) AS place,
                                  CAST(to_json({{'seller_id': CAST(seller_id AS VARCHAR), 'month': strftime(month, '%Y-%m'),
                                                'risk_level': level}}) AS VARCHAR) AS finding
                           FROM (SELECT seller_id, month,
                                        CASE WHEN delay_rate_pct > 30 OR max_delivery_delay_days > 15 THEN 'P0'
                                             WHEN delay_rate_pct >= 15 OR avg_delivery_delay_days > 7 THEN 'P1'
                                             WHEN delay_rate_pct >= 5 OR avg_delivery_delay_days >= 3 THEN 'P2' ELSE 'P3' END AS level
                                 FROM d)) GROUP BY seller_id) USING (seller_id))""",
        d=TASK_VIEWS["d"],
    )


ORACLES = {
    "task_creation": _over_tasks(
        f"""SELECT task_id, task_type, priority, 'pending' AS status, target_id, title, {_text("created_at")} FROM born"""
    ),
    "task_numbering_continued": _over_tasks(
        f"""SELECT 'RT-' || strftime(created_at, '%Y%m%d') || '-' || format('{{:04d}}', n_first + place) AS task_id,
                   title, {_text("created_at")}
            FROM (SELECT title || ' (2)' AS title, created_at, count(*) OVER (PARTITION BY created_at) AS n_first,
                         row_number() OVER (PARTITION BY created_at ORDER BY
                             md5(concat_ws('|', target_id, task_type, priority, title || ' (2)'))) AS place
                  FROM born)"""
    ),
    "task_validation": query_sql(
        """SELECT target_kind, target_id, cycle, task_type,
                  concat_ws('; ', CASE WHEN n % 11 = 0 THEN 'invalid priority' END, CASE WHEN n % 13 = 0 THEN 'title is empty' END,
                            CASE WHEN n % 17 = 0 AND length(assignee) * 40 > 128 THEN 'assignee is longer than 128' END) AS errors
           FROM (SELECT *, CAST(target_id AS BIGINT) AS n FROM fired)""",
        **TASK_VIEWS,
    ),
    "task_list": _over_tasks(
        f"""SELECT task_id, target_id, title, {_text("w.created_at", "created_at")} FROM worked w
            WHERE status = 'resolved' AND task_type = 'delivery_risk' AND priority = 'P1' AND contains(assignee, '专员')
            ORDER BY w.created_at DESC, task_id DESC LIMIT 50"""
    ),
    "task_list_open": _over_tasks(
        f"""SELECT task_id, priority, status, target_id, {_text("created_at")} FROM worked
            WHERE status IN ('pending', 'in_progress')"""
    ),
    "task_updates": _over_tasks(
        f"""SELECT task_id, coalesce(u.status, 'pending') AS status, coalesce(u.who, b.assignee) AS assignee,
                   {_text("coalesce(u.moment, b.created_at)", "updated_at")}, {_text("u.done_at", "resolved_at")},
                   coalesce(u.note, '') AS resolution_note
            FROM born b LEFT JOIN (
                SELECT task_id, arg_max(status, moment) AS status, max(moment) AS moment,
                       max(moment) FILTER (status IN ('resolved', 'closed')) AS done_at,
                       arg_max(note, moment) FILTER (note <> '') AS note, arg_max(who, moment) FILTER (who IS NOT NULL) AS who
                FROM updates WHERE status <> 'bogus' GROUP BY task_id) u USING (task_id)""",
        updates=_UPDATES,
    ),
    "task_update_report": _over_tasks(
        """SELECT u.status, CASE WHEN u.status = 'bogus' THEN 'invalid status' WHEN b.task_id IS NULL THEN 'not found'
                                 ELSE 'updated' END AS outcome, count(*) AS n_updates
           FROM updates u LEFT JOIN born b USING (task_id) GROUP BY ALL""",
        updates=_UPDATES,
    ),
    "task_close": _over_tasks(
        f"""SELECT task_id, CASE n % 4 WHEN 0 THEN 'resolved' WHEN 1 THEN 'closed' WHEN 2 THEN 'ignored' ELSE 'pending' END AS status,
                   {_text("CASE WHEN n % 4 = 3 THEN created_at ELSE created_at + to_hours(n % 20) END", "updated_at")},
                   {_text("CASE WHEN n % 4 < 2 THEN created_at + to_hours(n % 20) END", "resolved_at")},
                   CASE WHEN n % 4 = 3 THEN '' ELSE 'closed by desk' END AS resolution_note
            FROM born"""
    ),
    "task_stats": _over_tasks(
        """SELECT CASE WHEN status IS NOT NULL THEN 'status' WHEN task_type IS NOT NULL THEN 'task_type'
                       WHEN priority IS NOT NULL THEN 'priority' ELSE 'total' END AS dimension,
                  coalesce(status, task_type, priority, 'all') AS value, count(*) AS n_tasks
           FROM worked GROUP BY GROUPING SETS ((status), (task_type), (priority), ())"""
    ),
    "sla_breaches": _over_tasks(
        f"""SELECT task_id, priority, status, {_text("respond_by")}, {_text("resolve_by")}, response_breach, resolve_breach,
                   {_ESCALATE} AS escalate_to FROM sla WHERE response_breach OR resolve_breach""",
        sla=_SLA,
    ),
    "auto_close": _over_tasks(
        f"""SELECT task_id, CASE WHEN due THEN 'closed' ELSE status END AS status,
                   {_text(f"CASE WHEN due THEN {_NOW} ELSE updated_at END", "updated_at")}, {_text("resolved_at")}
            FROM (SELECT *, coalesce(status = 'resolved' AND resolved_at <= {_NOW} - INTERVAL 7 DAY, false) AS due FROM worked)"""
    ),
    "task_month_stats": _over_tasks(
        f"""SELECT CAST(date_trunc('month', created_at) AS DATE) AS month, task_type, priority, count(*) AS n_created,
                   count(resolved_at) AS n_resolved,
                   {share("count(*) FILTER (resolved_at IS NOT NULL AND NOT resolve_breach)", "count(*)")} AS in_sla_pct,
                   {nearest("sum(date_diff('second', created_at, resolved_at)) / nullif(count(resolved_at), 0)::DOUBLE / 3600.0", 6)} AS avg_resolve_hours,
                   {share(f"count(*) FILTER (priority IN ('P0', 'P1') AND {_ESCALATE} IS NOT NULL)", "count(*)")} AS escalated_pct
            FROM sla GROUP BY 1, 2, 3""",
        sla=_SLA,
    ),
    "task_recurrence": _over_tasks(
        f"""SELECT CAST(date_trunc('month', created_at) AS DATE) AS month, task_type, count(*) AS n_created,
                   count(*) FILTER (again) AS n_repeated, {share("count(*) FILTER (again)", "count(*)")} AS recurrence_pct
            FROM (SELECT *, coalesce(created_at - lag(created_at) OVER (PARTITION BY target_id, task_type ORDER BY created_at)
                                     <= INTERVAL 30 DAY, false) AS again FROM worked) GROUP BY 1, 2"""
    ),
    "tasks_from_findings": _findings("q", "place <= 3"),
    "tasks_from_whole_findings": _findings(
        """q || CASE request_id % 5 WHEN 0 THEN ' metric: defect rate' WHEN 1 THEN ' negative reviews' ELSE '' END""", "true"
    ),
}
