from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from orderwatch.operators import tasks
from orderwatch.operators.marts import build_marts
from orderwatch.sources import audit, documents, marketplace, records, store
from orderwatch.sources.records import read_lines


def test_missing_files_are_skipped(tables):
    assert set(tables) == set(marketplace.TABLE_FILES) - {"geolocation", "category_translation"}


def test_empty_folder_gives_no_tables(spark, tmp_path):
    assert marketplace.load_marketplace(spark, str(tmp_path)) == {}


def test_types_and_empty_values(tables):
    kinds = dict(tables["orders"].dtypes)
    assert kinds["order_purchase_timestamp"] == "timestamp" and kinds["order_status"] == "string"
    canceled = tables["orders"].filter("order_id = 'o4'").first()
    assert canceled.order_delivered_customer_date is None and canceled.order_approved_at is None


def test_quoted_line_breaks_and_quotes(tables):
    texts = rows(tables["order_reviews"], "review_id")
    assert texts["v1"]["review_comment_message"] == "warm light,\neasy to mount"
    assert texts["v3"]["review_comment_message"] == 'so "express" was slow'
    assert texts["v2"]["review_comment_message"] is None


def test_unparsed_times_are_counted(spark, csv_folder):
    raw = {"orders": marketplace.read_csv_table(spark, f"{csv_folder}/olist_orders_dataset.csv", "orders")}
    counts = rows(marketplace.unparsed_times(raw), "column_name")
    assert counts["order_approved_at"]["unparsed"] == 1 and counts["order_approved_at"]["filled"] == 7
    assert counts["order_purchase_timestamp"]["unparsed"] == 0


def test_file_audit(spark, tmp_path):
    (tmp_path / "good.csv").write_text("a\n1\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "blank.csv").write_text("\n  \n")
    (tmp_path / "header.csv").write_text("a,b\n")
    (tmp_path / "broken.csv").write_bytes(b"a,b\n\xff\xfe,1\n")
    names = ["good.csv", "empty.csv", "blank.csv", "header.csv", "broken.csv", "absent.csv"]
    found = rows(audit.audit_files(spark, str(tmp_path), names), "file_name")
    assert found["good.csv"] == {"file_name": "good.csv", "present": True, "problem": None}
    assert found["empty.csv"]["problem"] == found["blank.csv"]["problem"] == audit.EMPTY
    assert found["header.csv"]["problem"] == audit.NO_ROWS
    assert found["broken.csv"]["problem"] == audit.UNREADABLE
    assert found["absent.csv"] == {"file_name": "absent.csv", "present": False, "problem": audit.MISSING}


def test_file_audit_of_missing_folder(spark):
    found = audit.audit_files(spark, "/nowhere/at/all", ["x.csv"]).collect()
    assert [r.problem for r in found] == [audit.MISSING]


def test_catalog(spark, tables):
    marts = build_marts(tables, register=True)
    counts = rows(audit.catalog_counts(tables, marts), "name")
    assert counts["orders"]["n_rows"] == 7 and counts["orders_enriched"] == {
        "name": "orders_enriched", "kind": "mart", "n_rows": 7,
    }
    assert spark.table("seller_delivery_metrics").count() == 4
    assert audit.catalog_status(spark, tables, marts).first().status == "ok"
    assert audit.catalog_status(spark, {}, {}).first().status == "missing"
    partial = {n: tables[n] for n in ("orders", "customers")}
    assert build_marts(partial) == {}
    assert audit.catalog_status(spark, partial, {}).first().status == "warning"


def test_document_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("# A\ntext")
    (tmp_path / "sub" / "b.txt").write_text("plain")
    (tmp_path / "c.html").write_text("<p>x</p>")
    (tmp_path / "d.csv").write_text("no")
    found = documents.read_documents(spark, str(tmp_path))
    assert sorted((r.source.split("/")[-1], r.format) for r in found.collect()) == [
        ("a.md", "markdown"), ("b.txt", "text"), ("c.html", "html"),
    ]
    with pytest.raises(Exception, match="unsupported file format"):
        documents.read_documents(spark, str(tmp_path), "*.csv").collect()


def test_questions(spark, tmp_path):
    lines = [{"id": "1", "question": "q", "expected_intent": "mixed", "relevant_sop": None}, {"id": "2", "question": "r",
             "expected_intent": "unknown", "expected_tools": ["t"], "difficulty": "hard"}]
    (tmp_path / "q.jsonl").write_text("\n\n".join(map(json.dumps, lines)) + "\n")
    found = rows(documents.read_questions(spark, str(tmp_path / "q.jsonl")), "id")
    assert found["1"]["expected_tools"] == [] and found["1"]["difficulty"] == "easy"
    assert found["2"]["expected_tools"] == ["t"] and found["2"]["difficulty"] == "hard"


def test_task_store(spark, tmp_path):
    root = str(tmp_path / "store")
    assert store.read_snapshot(spark, root).count() == 0 and store.latest_version(spark, root) is None
    candidate = spark.createDataFrame(
        [("delivery_risk", "P0", "s1", "t", "d", "", "")],
        "task_type string, priority string, target_id string, title string, description string, sop_reference string, assignee string",
    )
    first = tasks.create_tasks(candidate, None, "2024-05-27 10:00:00")
    store.write_snapshot(first, root, 1)
    second = tasks.create_tasks(candidate, store.read_snapshot(spark, root), "2024-05-27 11:00:00")
    store.write_snapshot(second, root, 2)
    assert sorted(r.task_id for r in store.read_snapshot(spark, root).collect()) == ["RT-20240527-0001", "RT-20240527-0002"]
    assert store.read_snapshot(spark, root, 1).count() == 1


def test_task_json(spark, tmp_path):
    assert store.read_task_json(spark, str(tmp_path / "none.json")).count() == 0
    good = {"task_id": "RT-20240101-0001", "task_type": "delivery_risk", "created_at": "2024-01-01T00:00:00+00:00"}
    (tmp_path / "tasks.json").write_text(json.dumps([good, good | {"task_id": "RT-20240101-0002"}]))
    assert store.read_task_json(spark, str(tmp_path / "tasks.json")).count() == 2
    (tmp_path / "broken.json").write_text("[{]")
    assert store.read_task_json(spark, str(tmp_path / "broken.json")).count() == 0


def test_report_sink(spark, tmp_path):
    store.write_report({"summary": spark.range(3).select(F.col("id"))}, str(tmp_path), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "summary")).count() == 3


def test_json_lines_keep_every_record(spark, tmp_path):
    lines = "\n".join('{"task_id": "RT-%d", "title": "t"}' % k for k in range(3))
    (tmp_path / "lines.json").write_text(lines + "\nnot json\n")
    assert store.read_task_json(spark, str(tmp_path / "lines.json")).count() == 3
    texts = spark.read.text(str(tmp_path / "lines.json"), wholetext=True)
    assert {r.broken for r in store.parse_task_json(texts).collect()} == {1}


def test_quoted_lines_are_read_by_many_tasks(spark, tmp_path):
    """The same rows as Spark's reader across lines gives, from a file cut into small splits."""
    rng = random.Random(8)
    parts = ["plain", 'with ""quotes""', "two\nlines", "", "a, comma", "\n\nblank lines\n", '""', "ç é"]
    rows = [f'r{k},"{rng.choice(parts)}",{k % 5},"{rng.choice(parts)} {rng.choice(parts)}"' for k in range(4000)]
    text = "review_id,review_comment_title,review_score,review_comment_message\n" + "\n".join(rows) + "\n"
    (tmp_path / "reviews.csv").write_text(text, encoding="utf-8")
    path, before = str(tmp_path / "reviews.csv"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    want = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path).collect()
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        assert read_lines(spark, path).select("block").distinct().count() > 20
        got = marketplace.read_csv_table(spark, path, "order_reviews").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(map(str, got)) == sorted(str(r).replace("=''", "=None") for r in want)


def test_one_bad_record_costs_itself_only(spark, tmp_path):
    good = [{"task_id": f"RT-20240101-{k:04d}", "title": 'braces }, { and \\"quotes\\" inside', "priority": "P1"} for k in range(900)]
    texts = [json.dumps(t) for t in good]
    bad = ['{"task_id": "x', '{"title": "no id"}', "{]"]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    mixed = texts[:300] + bad[:1] + texts[300:600] + bad[1:] + texts[600:]
    shapes = {
        "lines": "\n".join(mixed),
        "array": "[" + ",\n".join(mixed) + "]",
        "pretty": json.dumps(good, indent=2).replace('"task_id": "RT-20240101-0500"', '"task_id": "RT-20240101-0500'),
        "one": "[" + ", ".join(texts) + "]",
    }
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        for name, text in shapes.items():
            (tmp_path / f"{name}.json").write_text(text)
            found = {r.task_id for r in store.read_task_json(spark, str(tmp_path / f"{name}.json")).collect()}
            assert found == {t["task_id"] for t in good} - ({"RT-20240101-0500"} if name == "pretty" else set()), name
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for text in ("[" + ", ".join(mixed) + "]", shapes["array"]):
        whole = store.parse_task_json(spark.createDataFrame([(text,)], "value string"))
        assert {r.task_id for r in whole.select("task.task_id").collect()} == {t["task_id"] for t in good}
    counted = store.parse_task_json(store.task_records(spark, str(tmp_path / "array.json")))
    assert counted.filter("task is null").agg({"broken": "sum"}).first()[0] == 3


def test_records_span_blocks_of_a_split(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "BLOCK_LINES", 3)
    rows = [(f"r{k}", "\n".join(f'{k} "{j}", x' for j in range(k % 9 + 1))) for k in range(40)]
    body = "\n".join(f'"{i}","{t.replace(chr(34), chr(34) * 2)}"' for i, t in rows)
    (tmp_path / "reviews.csv").write_text(f'"review_id","review_comment_message"\n{body}\n', newline="")
    lines = read_lines(spark, str(tmp_path / "reviews.csv"))
    assert lines.groupBy("file", "block", "part").count().agg({"count": "max"}).first()[0] == 3
    found = marketplace.read_csv_table(spark, str(tmp_path / "reviews.csv"), "order_reviews")
    assert sorted(map(tuple, found.collect())) == sorted(rows)
    # The header is told from the stored lines; no record is gathered twice for it.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("collect_list") == 1
