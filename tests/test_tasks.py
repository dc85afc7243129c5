from __future__ import annotations

import datetime as dt


from conftest import rows
from orderwatch.operators import tasks

CANDIDATE = "task_type string, priority string, target_id string, title string, description string, sop_reference string, assignee string"


def candidate(task_type="delivery_risk", priority="P0", target="s1", title="t", description="d", reference="", assignee="desk"):
    return (task_type, priority, target, title, description, reference, assignee)


def candidates(spark, *entries):
    return spark.createDataFrame(list(entries), CANDIDATE)


def store(spark, *entries):
    """Tasks from (id suffix, type, priority, status, target, assignee, created, updated, resolved)."""
    full = [
        (f"RT-{i}", kind, level, status, target, "t", "d", "", who, created, updated or created, resolved, "")
        for i, kind, level, status, target, who, created, updated, resolved in entries
    ]
    return spark.createDataFrame(full, tasks.TASK_SCHEMA)


T0 = dt.datetime(2024, 3, 1)


def hours(n):
    return T0 + dt.timedelta(hours=n)


def test_validation(spark):
    entries = [
        candidate(), candidate(task_type="other"), candidate(priority="P9", title=""), candidate(target="x" * 129),
        candidate(assignee="y" * 128, reference="z" * 513), candidate(description=None, task_type=None),
    ]
    errors = [r.errors for r in tasks.validate_tasks(candidates(spark, *entries)).collect()]
    assert errors == [
        [], ["invalid task_type"], ["invalid priority", "title is empty"], ["target_id is longer than 128"],
        ["sop_reference is longer than 512"], ["invalid task_type", "description is empty"],
    ]
    valid, rejected = tasks.split_valid(candidates(spark, *entries))
    assert valid.count() == 1 and rejected.count() == 5 and "errors" not in valid.columns


def test_numbers_are_dense_and_continue(spark):
    many = candidates(spark, *(candidate(target=f"s{i}") for i in range(300)))
    first = tasks.create_tasks(many, None, "2024-05-27 08:00:00")
    ids = sorted(r.task_id for r in first.collect())
    assert ids == [f"RT-20240527-{i:04d}" for i in range(1, 301)]
    second = tasks.create_tasks(many, first, "2024-05-27 09:00:00")
    assert sorted(r.task_id for r in second.collect())[-1] == "RT-20240527-0600" and second.count() == 600
    other = tasks.create_tasks(many.limit(2), second, "2024-05-28 09:00:00").filter("task_id like 'RT-20240528%'")
    assert sorted(r.task_id for r in other.collect()) == ["RT-20240528-0001", "RT-20240528-0002"]


def test_ids_survive_a_day_of_equal_tasks(spark):
    same = candidates(spark, *(candidate() for _ in range(50)))
    made = tasks.create_tasks(same, None, "2024-05-27 08:00:00")
    assert made.select("task_id").distinct().count() == 50


def test_more_than_four_digits(spark):
    old = store(spark, ("20240527-12345", "delivery_risk", "P0", "pending", "s", "", T0, None, None))
    new = tasks.create_tasks(candidates(spark, candidate()), old, "2024-05-27 08:00:00")
    assert "RT-20240527-12346" in {r.task_id for r in new.collect()}


def test_created_tasks(spark):
    row = tasks.create_tasks(candidates(spark, candidate(), candidate(priority="P7")), None, "2024-05-27 08:00:00").collect()
    assert len(row) == 1 and row[0].status == "pending" and row[0].resolved_at is None
    assert row[0].created_at == row[0].updated_at == dt.datetime(2024, 5, 27, 8)
    assert tuple(row[0].asDict()) == tasks.TASK_COLUMNS


def test_lists(spark):
    df = store(
        spark,
        ("1", "delivery_risk", "P2", "pending", "a", "Area Manager", hours(0), None, None),
        ("2", "review_triage", "P0", "in_progress", "b", "desk", hours(2), None, None),
        ("3", "delivery_risk", "P0", "resolved", "a", "AREA desk", hours(1), None, hours(3)),
        ("4", "delivery_risk", "??", "pending", "a", "", hours(3), None, None),
        ("5", "delivery_risk", "P1", "closed", "a", "", hours(4), None, hours(5)),
    )
    assert [r.task_id for r in tasks.list_tasks(df).collect()] == ["RT-5", "RT-4", "RT-2", "RT-3", "RT-1"]
    assert [r.task_id for r in tasks.list_tasks(df, assignee="area").collect()] == ["RT-3", "RT-1"]
    assert [r.task_id for r in tasks.list_tasks(df, status="pending", task_type="delivery_risk", priority="P2").collect()] == ["RT-1"]
    assert tasks.list_tasks(df, limit=2).count() == 2 and tasks.list_tasks(df, limit=None).count() == 5
    assert [r.task_id for r in tasks.open_tasks(df).collect()] == ["RT-2", "RT-1", "RT-4"]
    assert tasks.get_task(df, "RT-2").first().target_id == "b" and tasks.get_task(df, "none").count() == 0


def test_updates_of_one_moment_and_without_time(spark):
    df = store(
        spark,
        *((str(n), "delivery_risk", "P0", "pending", "a", "desk", T0, None, None) for n in (1, 2)),
    )
    updates = spark.createDataFrame(
        [
            ("RT-1", "resolved", "first", None, hours(1), 1), ("RT-1", "in_progress", "second", None, hours(1), 2),
            ("RT-2", "in_progress", "no time", "ann", None, 1),
        ],
        "task_id string, status string, resolution_note string, assignee string, updated_at timestamp, sequence int",
    )
    found = rows(tasks.apply_updates(df, updates), "task_id")
    assert (found["RT-1"]["status"], found["RT-1"]["resolution_note"]) == ("in_progress", "second")
    assert (found["RT-2"]["status"], found["RT-2"]["assignee"], found["RT-2"]["updated_at"]) == ("in_progress", "ann", T0)
    plain = rows(tasks.apply_updates(df, updates.drop("sequence")), "task_id")
    assert plain["RT-1"]["status"] == "resolved"  # by content where nothing tells the order


def test_updates(spark):
    df = store(
        spark,
        ("1", "delivery_risk", "P0", "pending", "a", "desk", T0, None, None),
        ("2", "delivery_risk", "P0", "pending", "a", "desk", T0, None, None),
        ("3", "delivery_risk", "P0", "pending", "a", "desk", T0, None, None),
    )
    updates = spark.createDataFrame(
        [
            ("RT-1", "in_progress", "looking", "ann", hours(1)), ("RT-1", "resolved", "", None, hours(2)),
            ("RT-2", "resolved", "fixed", "", hours(1)), ("RT-2", "pending", "", None, hours(3)),
            ("RT-3", "escalated", "x", "y", hours(1)), ("RT-9", "closed", "", None, hours(1)),
        ],
        "task_id string, status string, resolution_note string, assignee string, updated_at timestamp",
    )
    found = rows(tasks.apply_updates(df, updates), "task_id")
    one, two, three = found["RT-1"], found["RT-2"], found["RT-3"]
    assert (one["status"], one["assignee"], one["resolution_note"]) == ("resolved", "ann", "looking")
    assert one["resolved_at"] == one["updated_at"] == hours(2)
    assert (two["status"], two["assignee"], two["resolved_at"], two["updated_at"]) == ("pending", "", hours(1), hours(3))
    assert three["status"] == "pending" and three["updated_at"] == T0 and len(found) == 3
    report = sorted((r.task_id, r.status, r.outcome) for r in tasks.update_report(df, updates).collect())
    assert ("RT-3", "escalated", "invalid status") in report and ("RT-9", "closed", "not found") in report
    assert ("RT-1", "resolved", "updated") in report


def test_closing(spark):
    df = store(spark, *((str(i), "delivery_risk", "P0", "pending", "a", "", T0, None, None) for i in range(3)))
    requests = spark.createDataFrame(
        [("RT-0", None, "ok", None, hours(1)), ("RT-1", "ignored", "no", None, hours(1)), ("RT-2", "in_progress", "", None, hours(1))],
        "task_id string, status string, resolution_note string, assignee string, updated_at timestamp",
    )
    found = rows(tasks.close_tasks(df, requests), "task_id")
    assert [found[f"RT-{i}"]["status"] for i in range(3)] == ["resolved", "ignored", "pending"]
    assert [found[f"RT-{i}"]["resolved_at"] for i in range(3)] == [hours(1), None, None]


def test_stats(spark):
    df = store(
        spark,
        ("1", "delivery_risk", "P0", "pending", "a", "", T0, None, None),
        ("2", "delivery_risk", "P1", "closed", "a", "", T0, None, T0),
    )
    found = {(r.dimension, r.value): r.n_tasks for r in tasks.task_stats(df).collect()}
    assert found == {
        ("total", "all"): 2, ("status", "pending"): 1, ("status", "closed"): 1, ("task_type", "delivery_risk"): 2,
        ("priority", "P0"): 1, ("priority", "P1"): 1,
    }


def test_deduplication(spark):
    schema = "target_kind string, target_id string, cycle string, task_type string, priority string, title string"
    entries = [
        ("seller", "A", "w1", "review_triage", "P1", "r"), ("seller", "A", "w1", "delivery_risk", "P0", "d"),
        ("seller", "A", "w2", "review_triage", "P1", "r2"), ("product", "A", "w1", "quality_inspection", "P1", "q"),
    ] + [("seller", "H", "w1", "review_triage", "P1", f"x{i}") for i in range(200)]
    found = rows(tasks.deduplicate(spark.createDataFrame(entries, schema)), "target_kind", "target_id", "cycle")
    a = found[("seller", "A", "w1")]
    assert (a["task_type"], a["priority"], a["title"], a["sub_items"]) == ("delivery_risk", "P0", "d", ["P1:review_triage"])
    assert found[("seller", "A", "w2")]["sub_items"] == [] and len(found) == 4
    assert found[("seller", "H", "w1")]["n_candidates"] == 200 and found[("seller", "H", "w1")]["sub_items"] == []


def test_sla(spark):
    df = store(
        spark,
        ("1", "delivery_risk", "P0", "pending", "a", "", hours(0), None, None),
        ("2", "delivery_risk", "P0", "resolved", "a", "", hours(0), hours(24), hours(24)),
        ("3", "delivery_risk", "P1", "in_progress", "a", "", hours(0), hours(5), None),
        ("4", "delivery_risk", "P3", "pending", "a", "", hours(0), None, None),
        ("5", "delivery_risk", "P0", "ignored", "a", "", hours(0), hours(1), None),
    )
    found = rows(tasks.sla_state(df, "2024-03-02 01:00:00"), "task_id")
    assert [found[f"RT-{i}"]["response_breach"] for i in range(1, 6)] == [True, True, False, False, False]
    assert [found[f"RT-{i}"]["resolve_breach"] for i in range(1, 6)] == [True, False, False, False, False]
    assert [found[f"RT-{i}"]["escalate_to"] for i in range(1, 6)] == ["director", None, None, None, None]


def test_auto_close(spark):
    df = store(
        spark,
        ("1", "delivery_risk", "P0", "resolved", "a", "", hours(0), hours(0), hours(0)),
        ("2", "delivery_risk", "P0", "resolved", "a", "", hours(0), hours(1), hours(1)),
        ("3", "delivery_risk", "P0", "pending", "a", "", hours(0), None, None),
    )
    found = rows(tasks.auto_close(df, "2024-03-08 00:00:00"), "task_id")
    assert [found[f"RT-{i}"]["status"] for i in (1, 2, 3)] == ["closed", "resolved", "pending"]
    assert found["RT-1"]["updated_at"] == dt.datetime(2024, 3, 8) and found["RT-1"]["resolved_at"] == hours(0)


def test_month_stats(spark):
    df = store(
        spark,
        ("1", "delivery_risk", "P0", "resolved", "a", "", hours(0), hours(10), hours(10)),
        ("2", "delivery_risk", "P0", "resolved", "a", "", hours(0), hours(30), hours(30)),
        ("3", "delivery_risk", "P0", "pending", "a", "", hours(0), None, None),
    )
    row = tasks.task_month_stats(df, "2024-03-20 00:00:00").first()
    assert (row.n_created, row.n_resolved, row.in_sla_pct, row.avg_resolve_hours, row.escalated_pct) == (3, 2, 33.33, 20.0, 33.33)


def test_recurrence_against_brute_force(spark):
    entries, number = [], 0
    for target in range(6):
        for i in range(40):
            day = (i * (target * 13 + 7)) % 400
            number += 1
            entries.append((str(number), "delivery_risk", "P1", "pending", f"s{target}", "", T0 + dt.timedelta(days=day), None, None))
    for _ in range(300):  # one target with most of the tasks, many at one time
        number += 1
        entries.append((str(number), "review_triage", "P1", "pending", "hot", "", T0 + dt.timedelta(days=number % 3 * 31), None, None))
    found = {(r.month, r.task_type): (r.n_created, r.n_repeated) for r in tasks.task_recurrence(store(spark, *entries)).collect()}
    expected, seen = {}, {}
    for _, kind, _, _, target, _, created, _, _ in sorted(entries, key=lambda e: e[6]):
        month = created.date().replace(day=1)
        last = seen.get((target, kind))
        again = last is not None and created - last <= dt.timedelta(days=30)
        seen[(target, kind)] = created
        n, r = expected.get((month, kind), (0, 0))
        expected[(month, kind)] = (n + 1, r + again)
    assert found == expected


def test_tasks_from_findings(spark):
    requests = spark.createDataFrame(
        [(1, "Review seller A", 0), (2, "create P1 task for product x", 12), (3, "what now", 0), (4, "check", 0)],
        "request_id long, request string, context_chars int",
    )
    findings = spark.createDataFrame(
        [
            (1, 0, "A", None, None, "??", '{"n":0}'), (1, 1, "B", None, None, "P0", '{"n":1}'),
            (1, 2, None, "p", None, "P3", "x" * 400), (1, 3, None, None, "o", "P1", '{"n":3}'),
            (4, 0, None, "p9", "o9", "P3", "{}"), (4, 1, "s9", None, None, "P0", "{}"),
        ],
        "request_id long, position int, seller_id string, product_id string, order_id string, risk_level string, finding string",
    )
    found = rows(tasks.tasks_from_findings(requests, findings), "request_id")
    one, two, three, four = (found[i] for i in (1, 2, 3, 4))
    assert (one["task_type"], one["priority"], one["target_id"], one["should_create"]) == ("review_triage", "P0", "A", True)
    assert one["title"] == "[P0] Inspection for A"
    assert one["description"] == (
        'Auto-generated from query: Review seller A\nMetric findings:\n  - {"n":0}\n  - {"n":1}\n  - ' + "x" * 300
    )
    assert (two["task_type"], two["priority"], two["target_id"], two["should_create"]) == (
        "quality_inspection", "P1", "unknown_target", True,
    )
    assert two["description"].endswith("\nSOP context available (12 chars)")
    assert (three["priority"], three["should_create"], three["task_type"]) == ("P2", False, "delivery_risk")
    assert (four["priority"], four["target_id"], four["should_create"]) == ("P3", "p9", True)
    planned = requests.selectExpr("*", "CASE WHEN request_id = 3 THEN 'Look at a DEFECT' END AS plan")
    whole = rows(tasks.tasks_from_findings(planned, findings, max_findings=None, finding_chars=None), "request_id")
    assert whole[1]["description"].endswith("\n  - " + "x" * 400 + '\n  - {"n":3}')
    assert (whole[3]["task_type"], whole[4]["task_type"]) == ("quality_inspection", "delivery_risk")


def test_columns_are_stable(spark):
    df = store(spark, ("1", "delivery_risk", "P0", "pending", "a", "", T0, None, None))
    assert tuple(tasks.auto_close(df, "2024-03-08").columns) == tasks.TASK_COLUMNS


def test_candidates_are_worked_out_once(spark):
    new = candidates(spark, *(candidate(target=f"s{k}") for k in range(5))).selectExpr("*", "timestamp'2024-03-01' AS created_at")
    numbered = tasks.number_tasks(new)
    plan = numbered._jdf.queryExecution().optimizedPlan().toString()
    assert "unnumbered" in " ".join(numbered.inputFiles()) and "LogicalRDD" not in plan and "LocalRelation" not in plan
    assert sorted(r.task_id for r in numbered.collect()) == [f"RT-20240301-{k:04d}" for k in range(1, 6)]
