from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from orderwatch.operators import documents

SCHEMA = "source string, text string, format string"


def docs(spark, *entries):
    return spark.createDataFrame([(s, t, f) for s, t, f in entries], SCHEMA)


def listed(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("source", "page").collect()]


def test_sections_pages_and_paragraphs(spark):
    text = "before\n\n# One\nfirst line\n  second line  \n\nnext\n## Two\nx\n### Three\ny\n## Four\nz\n# Five\nend"
    found = documents.elements(docs(spark, ("a", text, "markdown")))
    assert listed(found, "page", "section", "text") == [
        (0, "", "before"),
        (1, "One", "first line\nsecond line"),
        (2, "One", "next"),
        (3, "One > Two", "x"),
        (4, "One > Two > Three", "y"),
        (5, "One > Two > Three > Four", "z"),
        (6, "Five", "end"),
    ]
    nested = documents.elements(docs(spark, ("a", text, "markdown")), hierarchical=True)
    assert [s for (s,) in listed(nested, "section")] == [
        "", "One", "One", "One > Two", "One > Two > Three", "One > Four", "Five",
    ]


def test_what_is_a_heading(spark):
    text = "#no\n####### seven\n # indented\n#\tTab title \t\nbody\n#  \nlast\n## Deep\nx"
    found = listed(documents.elements(docs(spark, ("a", text, "markdown"))), "section", "text")
    assert found == [
        ("", "#no\n####### seven\n# indented"),
        ("Tab title", "body"),
        ("", "last"),
        ("Deep", "x"),
    ]


def test_line_ends_and_unicode_space(spark):
    text = "# T\r\none\rtwo 　three \r\n\r\n　\nfour"
    found = listed(documents.elements(docs(spark, ("a", text, "markdown"))), "section", "text")
    assert found == [("T", "one\ntwo\nthree"), ("T", "four")]


def test_nothing_in_nothing_out(spark):
    empty = docs(spark, ("a", "", "markdown"), ("b", "# Only a title\n\n", "markdown"), ("c", " \n ", "text"))
    assert documents.elements(empty).count() == 0 and documents.chunks(empty).count() == 0


@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("Checklist for p0", "checklist"), ("核查项", "checklist"), ("over http2", "threshold"), ("阈值", "threshold"),
        ("an Example step", "example"), ("next STEP", "procedure"), ("工作流", "procedure"), ("reply template", "template"),
        ("必须", "rule"), ("plain words", "paragraph"), ("x" * 205 + " checklist", "paragraph"),
    ],
)
def test_content_types(spark, text, kind):
    row = documents.elements(docs(spark, ("a", text, "markdown"))).first()
    assert row.content_type == kind


def test_type_from_section(spark):
    assert documents.elements(docs(spark, ("a", "# Procedure\nbody", "markdown"))).first().content_type == "procedure"


def test_element_ids(spark):
    long = "é" * 150
    row = documents.elements(docs(spark, ("src", f"# T\n{long}", "markdown"))).first()
    assert row.element_id == hashlib.sha1(f"src|T|{'é' * 150}".encode()).hexdigest()[:12]


def test_plain_text_is_one_paragraph(spark):
    found = documents.elements(docs(spark, ("a", "  # not a title\n\np0 here \n", "text")))
    assert listed(found, "text", "section", "content_type") == [("# not a title\n\np0 here", "", "paragraph")]


def test_pages(spark):
    html = (
        "<html><head><title>no</title><style>p{}</style></head><body><!-- <p>no</p> --><h1 class=x>Big &amp; small</h1>"
        "<p>one <b>bold</b>\nline</p><ul><li>item &lt;1&gt;</li></ul><H2>Sub</H2><p>two</p><script>var a='<p>';</script></body>"
    )
    found = listed(documents.elements(docs(spark, ("a", html, "html"))), "section", "text", "content_type")
    assert found == [
        ("Big & small", "one bold line", "paragraph"),
        ("Big & small", "item <1>", "paragraph"),
        ("Big & small > Sub", "two", "paragraph"),
    ]


def chunk_rows(df):
    return [(r.chunk_id, r.section, r.parent_section, r.content_type, r.text) for r in df.orderBy("chunk_id").collect()]


def test_chunks_split_at_sections(spark):
    body = "word " * 15
    text = f"# A\n{body}\n\n{body}\n## B\n{body}\n### C\n{body}"
    found = chunk_rows(documents.chunks(docs(spark, ("d", text, "markdown"))))
    plain = body.strip()
    assert found == [
        ("d_0001", "A", "", "paragraph", f"{plain}\n\n{plain}"),
        ("d_0002", "A > B", "A", "paragraph", plain),
        ("d_0003", "A > B > C", "A > B", "paragraph", plain),
    ]


def expected_chunks(elements, min_chars, max_chars):
    """Plain restatement of the rules for one document."""
    groups, buffer, section = [], [], ""
    for el in elements:
        if el.section and el.section != section:
            section = el.section
            if buffer:
                groups.append(buffer)
                buffer = []
        buffer = [*buffer, el]
        if len("\n\n".join(e.text for e in buffer)) >= max_chars and el.content_type not in documents.ATOMIC_TYPES:
            groups.append(buffer)
            buffer = []
    if buffer:
        groups.append(buffer)
    texts = ["\n\n".join(e.text for e in g) for g in groups]
    merged = []
    for text in texts:
        if merged and len(text) < min_chars:
            merged[-1] += "\n\n" + text
        else:
            merged.append(text)
    return merged


def test_chunk_sizes_against_brute_force(spark):
    entries = []
    for d in range(12):
        lines = []
        for i in range(60):
            if (d * 7 + i * 3) % 11 == 0:
                lines.append("#" * (1 + (i + d) % 3) + f" Head {i}")
            kind = ("checklist ", "", "template ")[(i * d) % 3]
            lines += [kind + "w" * ((i * 37 + d * 13) % 90 + 1), ""]
        entries.append((f"doc{d}", "\n".join(lines), "markdown"))
    df = docs(spark, *entries)
    found = {}
    for r in documents.chunks(df, 50, 300).orderBy("chunk_id").collect():
        found.setdefault(r.source, []).append(r.text)
    by_doc = {}
    for r in documents.elements(df).orderBy("source", "page").collect():
        by_doc.setdefault(r.source, []).append(r)
    assert found == {s: expected_chunks(rows, 50, 300) for s, rows in by_doc.items()}


def test_small_first_chunk_stands_and_numbers_skip_merged(spark):
    body = "long enough to stand alone, fifty characters or more"
    text = f"# A\ntiny\n# B\n{body}\n# C\nsmall\n# D\n{body}"
    found = chunk_rows(documents.chunks(docs(spark, ("d", text, "markdown"))))
    assert [(f[0], f[1], f[4]) for f in found] == [
        ("d_0001", "A", "tiny"), ("d_0002", "B", f"{body}\n\nsmall"), ("d_0004", "D", body),
    ]


def test_stats(spark):
    found = documents.chunk_stats(documents.chunks(docs(spark, ("a", "x", "markdown"), ("b", "checklist", "markdown"))))
    assert {(r.dimension, r.value): r.n_chunks for r in found.collect()} == {
        ("total", "all"): 2, ("source", "a"): 1, ("source", "b"): 1, ("content_type", "paragraph"): 1,
        ("content_type", "checklist"): 1,
    }


def test_preparation_needs_no_shuffle(spark):
    df = documents.chunks(docs(spark, ("a", "# T\nx", "markdown")))
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_extra_columns_are_kept(spark):
    df = docs(spark, ("a", "x", "markdown")).withColumn("lang", F.lit("en"))
    assert documents.elements(df).first().lang == "en" and documents.chunks(df).first().lang == "en"


def test_content_type_of_whole_texts(spark):
    late = "plain words " * 30 + "and then a checklist"
    docs = spark.createDataFrame([("a.md", late)], "source string, text string")
    assert documents.elements(docs).first().content_type == "paragraph"
    assert documents.elements(docs, head_chars=None).first().content_type == "checklist"


@pytest.mark.parametrize("hierarchical", [False, True])
def test_many_headings(spark, hierarchical):
    """Paths of thousands of headings, against a plain stack."""
    rng = random.Random(3)
    levels = [rng.choice([1, 2, 2, 3, 3, 4, 6]) for _ in range(2000)]
    text = "before\n\n" + "".join(f"{'#' * level} h{k}\n\ntext {k}\n\n" for k, level in enumerate(levels))
    want, open_ = [""], []
    for k, level in enumerate(levels):
        if level == 1:
            open_ = []
        elif hierarchical:
            open_ = [h for h in open_ if h[0] < level]
        open_ = [*open_, (level, f"h{k}")]
        want.append(" > ".join(t for _, t in open_))
    df = documents.elements(spark.createDataFrame([("a", text)], "source string, text string"), hierarchical=hierarchical)
    assert [r.section for r in df.orderBy("page").collect()] == want
