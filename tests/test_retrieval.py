from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from orderwatch.operators import retrieval
from orderwatch.operators.index import build_index, open_index

CHUNK_SCHEMA = "chunk_id string, text string, source string, section string, parent_section string, content_type string"
CHUNKS = [
    ("c1", "Seller delivery delay risk and the delay threshold P0", "sop/delivery.md", "Delivery > Levels", "Delivery", "threshold"),
    ("c2", "Checklist for the review of low ratings", "sop/review.md", "Review > Checklist", "Review", "checklist"),
    ("c3", "Product quality and defect rates; delivery is not covered", "sop/product.md", "Quality", "", "paragraph"),
    ("c4", "Order delay_rate=35% means escalation of delays", "sop/delivery.md", "Delivery > Example", "Delivery", "example"),
    ("c5", "   ", "sop/empty.md", "", "", "paragraph"),
    ("c6", "物流延迟 处理 流程 don't panic", "sop/zh.md", "流程", "", "procedure"),
    ("c7", "delivery " * 30 + "notes", "sop/notes.md", "Notes", "", "paragraph"),
]
QUERIES = [
    (1, "delivery delay"),
    (2, "defect zzzz"),
    (3, "elay"),
    (4, "xyzzy"),
    (5, "delay-rate"),
    (6, "delay_rate=35"),
    (7, '"deliv"* DEL del'),
    (8, "don't"),
    (9, "rate=3"),
    (10, "???"),
    (11, "=35%"),
    (12, "延迟"),
    (13, "物流"),
    (14, "for the review of"),
    (15, "quality and defect rates; delivery"),
    (16, ""),
    (17, "review zzzz ratings zzzz"),
]


def words(text):
    return [t for t in re.split(r"[\W_]+", text.lower()) if t]


def brute_force(chunks, queries, top_k, weights=None, content_type=None):
    """Every query against every chunk, by the definitions."""
    weights = weights or {"text": 1.0}
    names = CHUNK_SCHEMA.split(", ")
    rows = [dict(zip((n.split()[0] for n in names), c)) for c in chunks if c[1].strip()]
    fields = {r["chunk_id"]: {f: words(r[f]) for f in retrieval.INDEXED} for r in rows}
    length = {c: sum(map(len, f.values())) for c, f in fields.items()}
    mean = sum(length.values()) / len(rows)

    def places(chunk, phrase):
        parts, count, weight = phrase.split(" "), 0, 0.0
        for name, tokens in fields[chunk].items():
            for i in range(len(tokens) - len(parts) + 1):
                if " ".join(tokens[i : i + len(parts)]).startswith(phrase):
                    count, weight = count + 1, weight + weights.get(name, 0.0)
        return count, weight

    answers = {}
    for query_id, query in queries:
        terms = [" ".join(words(w)) for w in re.sub(r'["*]', " ", query.replace("-", " ")).split()]
        scores = {}
        for r in rows:
            matched, score = set(), 0.0
            for term in terms:
                if not term:
                    continue
                n, tf = places(r["chunk_id"], term)
                if n:
                    df = sum(1 for c in fields if places(c, term)[0])
                    idf = max(math.log((len(rows) - df + 0.5) / (df + 0.5)), 1e-6)
                    part = tf + 1.2 * (0.25 + 0.75 * length[r["chunk_id"]] / mean)
                    matched.add(term)
                    score += idf * tf * 2.2 / part
            if matched:
                scores[r["chunk_id"]] = (len(matched) == len(set(terms)), score)
        allowed = {r["chunk_id"] for r in rows if content_type in (None, r["content_type"])}
        scores = {c: s for c, s in scores.items() if c in allowed}
        found = {c: s for c, (full, s) in scores.items() if full}
        kind = "all"
        if not found and len(query.split()) > 1:
            found, kind = {c: s for c, (_, s) in scores.items()}, "any"
        if not found and query:
            found = {r["chunk_id"]: 999.0 for r in rows if query.lower() in r["text"].lower() and r["chunk_id"] in allowed}
            kind = "substring"
        best = sorted(found.items(), key=lambda x: (-round(x[1], 6), x[0]))[:top_k]
        answers[query_id] = [(c, round(s, 5), kind) for c, s in best]
    return answers


def answers_of(df, queries):
    found = {q: [] for q, _ in queries}
    for r in df.orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.chunk_id, round(r.score, 5), r.matched_by))
    return found


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, CHUNK_SCHEMA).cache()


@pytest.fixture(scope="module")
def index(chunks):
    return build_index(chunks)


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame(QUERIES, "query_id long, query string").cache()


def test_search_against_brute_force(chunks, queries):
    found = answers_of(retrieval.search(chunks, queries, 3), QUERIES)
    assert found == brute_force(CHUNKS, QUERIES, 3)


def test_phases(chunks, queries):
    found = answers_of(retrieval.search(chunks, queries, 5), QUERIES)
    kinds = {q: {k for _, _, k in a} for q, a in found.items()}
    assert kinds[1] == {"all"} and kinds[2] == {"any"} and kinds[3] == {"substring"}
    assert found[4] == [] and found[16] == []
    assert [c for c, _, _ in found[6]] == ["c4"]  # one phrase, its parts in order


def test_weights_and_type_filter(chunks, queries):
    weights = {"source": 2.0, "text": 0.5}
    found = answers_of(retrieval.search(chunks, queries, 4, weights=weights), QUERIES)
    assert found == brute_force(CHUNKS, QUERIES, 4, weights)
    typed = answers_of(retrieval.search(chunks, queries, 4, content_type="example"), QUERIES)
    assert typed == brute_force(CHUNKS, QUERIES, 4, content_type="example")


def test_literal_search_against_brute_force(spark, chunks):
    texts = [c[1].lower() for c in CHUNKS if c[1].strip()]
    asked = [(i, q) for i, (_, q) in enumerate(QUERIES)]
    for text in texts:
        for start in range(0, min(len(text), 60), 5):
            for size in (1, 2, 3, 7, 20):
                asked.append((len(asked), text[start : start + size]))
    df = retrieval.substring_search(chunks, spark.createDataFrame(asked, "query_id long, query string"), 100)
    found = {(r.query_id, r.chunk_id) for r in df.collect()}
    assert found == {
        (i, c[0]) for i, q in asked for c in CHUNKS if q and c[1].strip() and q.lower() in c[1].lower()
    }


def test_one_source_with_most_of_the_chunks(spark):
    texts = ["common words about delivery", "rare gem", "delivery of a gem"]
    many = [(f"big_{i:04d}", texts[i % 3] + f" n{i}", "big.md", "S", "", "paragraph") for i in range(600)]
    many += [(f"small_{i:04d}", "rare gem delivery", f"s{i}.md", "S", "", "paragraph") for i in range(30)]
    asked = [(1, "gem"), (2, "common gem"), (3, "delivery"), (4, "n59")]
    df = spark.createDataFrame(many, CHUNK_SCHEMA)
    found = retrieval.search(df, spark.createDataFrame(asked, "query_id long, query string"), 7)
    assert answers_of(found, asked) == brute_force(many, asked, 7)


def test_retrieve_filters_boosts_and_keeps_details(spark, chunks):
    asked = spark.createDataFrame(
        [(1, "delivery", ["threshold", "paragraph"], ["levels"]), (2, "delivery", None, None), (3, "delay", [], ["Example", "deliv"])],
        "query_id long, query string, include_types array<string>, prefer_sections array<string>",
    )
    found = retrieval.retrieve(chunks, asked, 2).orderBy("query_id", "rank").collect()
    plain = {r.chunk_id: r.score for r in retrieval.search(chunks, asked.select("query_id", "query"), 9).collect() if r.query_id == 2}
    first = [r for r in found if r.query_id == 1]
    assert all(r.content_type in ("threshold", "paragraph") for r in first)
    assert {r.chunk_id: round(r.score - plain[r.chunk_id], 6) for r in first}.get("c1") == 0.5
    assert len([r for r in found if r.query_id == 2]) == 2
    third = [r for r in found if r.query_id == 3]
    assert third[0].chunk_id == "c4" and third[0].source == "sop/delivery.md"


def test_context_and_citations(chunks, queries):
    found = retrieval.retrieve(chunks, queries.filter("query_id = 1"), 2)
    text = retrieval.context(found).first()
    listed = retrieval.citations(found).first().sources
    first, second = (r.chunk_id for r in found.orderBy("rank").collect())
    body = {c[0]: c for c in CHUNKS}
    assert text.n_chunks == 2 and [s.chunk_id for s in listed] == [first, second]
    block = "### [{}] source={}, section={}, type={}\n{}\n"
    parts = [block.format(i, body[c][2], body[c][3], body[c][5], body[c][1]) for i, c in ((1, first), (2, second))]
    assert text.context == "## Retrieved SOP Context\n\n" + "\n".join(parts)


def test_index_tables(chunks):
    posted = retrieval.postings(chunks)
    assert posted.filter("term = 'delivery' and chunk_id = 'c7' and field = 'text'").first().tf == 30
    terms = {r.term: (r.df, r.cf) for r in retrieval.vocabulary(posted).collect()}
    assert terms["delay"] == (2, 3) and "" not in terms
    stats = retrieval.corpus_stats(chunks).first()
    lengths = [sum(len(words(c[i])) for i in range(1, 6)) for c in CHUNKS if c[1].strip()]
    assert stats.n_chunks == 6 and stats.avg_tokens == pytest.approx(sum(lengths) / 6)


def test_search_reads_the_index_only(spark, index, queries):
    """No plan of a search splits a text, and texts are read for literal candidates alone."""
    found = retrieval.search(open_index(spark, index.path), queries, 3)
    assert answers_of(found, QUERIES) == brute_force(CHUNKS, QUERIES, 3)
    phrases = retrieval.query_phrases(queries).filter("phrase != ''").withColumn("phrase_no", F.xxhash64("phrase"))
    hits = retrieval.phrase_hits(index, phrases)
    for df in (found, hits):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan
        assert not any("split(" in line and "text#" in line for line in plan.splitlines())
    ranked = retrieval.search(index, queries, 3, fallback=False)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in ranked.replace("/tmp", "")


def test_numbers_follow_the_sorted_terms(spark, index):
    terms = index.table("terms").orderBy("term").collect()
    assert [r.term_no for r in terms] == list(range(len(terms)))
    for r in index.table("prefixes").collect():
        assert [t.term_no for t in terms if t.term.startswith(r.prefix)] == list(range(r.low, r.high + 1))


def test_a_word_of_many_parts(spark):
    parts = [f"p{k % 40}" for k in range(150)]
    long = "x" * 40
    texts = ["-".join(parts), " ".join(parts[:149]) + " p2", " ".join(parts) + "9", f"{long}abc tail", f"{long}abd"]
    rows = [(f"c{k}", t, "s", "", "", "paragraph") for k, t in enumerate(texts)]
    asked = [(1, "_".join(parts)), (2, f"{long}ab"), (3, f"{long}abd"), (4, "_".join(parts[:30])), (5, f"{long[:33]}")]
    df = spark.createDataFrame(asked, "query_id long, query string")
    assert answers_of(retrieval.search(spark.createDataFrame(rows, CHUNK_SCHEMA), df, 5), asked) == brute_force(rows, asked, 5)


def test_pruned_answers_to_any_word_are_complete(spark):
    """Many chunks with some of the words, none with all: the best are those of a full scan."""
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(60)]
    weights = [1 / (k + 1) for k in range(60)]
    rows = [(f"c{k:03d}", " ".join(rng.choices(vocabulary, weights, k=rng.randrange(2, 30))), f"s{k % 3}", "", "", ["rule", "example"][k % 2]) for k in range(300)]
    asked = [(q, " ".join({f"{w} " for w in rng.sample(vocabulary, 9)}) + "missing") for q in range(12)]
    df = spark.createDataFrame(asked, "query_id long, query string")
    index = build_index(spark.createDataFrame(rows, CHUNK_SCHEMA))
    for top_k in (1, 4, 400):
        assert answers_of(retrieval.search(index, df, top_k), asked) == brute_force(rows, asked, top_k)
    typed = retrieval.search(index, df, 3, content_type="rule")
    assert answers_of(typed, asked) == brute_force(rows, asked, 3, content_type="rule")


def test_no_queries(spark, chunks):
    none = spark.createDataFrame([], "query_id long, query string")
    assert retrieval.search(chunks, none).count() == 0
    assert retrieval.retrieve(chunks, none.withColumn("x", F.lit(1)).drop("x")).count() == 0


def test_blanks_and_accents_of_any_kind(spark):
    texts = [("a", "Entrega lenta em São Paulo"), ("b", "delivery was slow"), ("c", "\r\n\u3000"), ("d", "cafe\u0301 novo")]
    chunks = spark.createDataFrame([(i, t, "", "", "", "") for i, t in texts], CHUNK_SCHEMA)
    asked = ["sao paulo", "SÃO", "delivery\u3000slow", "slow\u00a0delivery", "café", "cafe"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    found = retrieval.search(chunks, queries).collect()
    assert sorted((r.query_id, r.chunk_id) for r in found) == [(0, "a"), (1, "a"), (2, "b"), (3, "b"), (4, "d"), (5, "d")]
    assert retrieval.corpus_stats(chunks).first().n_chunks == 3


def test_grams_are_not_shuffled_for_a_few_needles(spark):
    chunks = spark.createDataFrame([("c1", "abcde fghij"), ("c2", "xxcdexx")], "chunk_id string, text string")
    index = build_index(chunks, columns=["text"])
    needles = spark.createDataFrame([(1, "cde"), (2, "zzz")], "query_id int, needle string")
    held = retrieval._holding(index, needles)
    assert any("/rarest-" in f for f in held.inputFiles())
    terms = {r.term_no: r.term for r in index.table("terms").collect()}
    assert sorted((r.query_id, terms[r.term_no]) for r in held.collect()) == [(1, "abcde"), (1, "xxcdexx")]


def test_hits_of_a_chunk_meet_without_a_shuffle(spark, index, queries):
    phrases = retrieval.query_phrases(queries).filter("phrase != ''").withColumn("phrase_no", F.xxhash64("phrase"))
    for n in ("n_parts = 1", "n_parts >= 1"):
        plan = retrieval.phrase_hits(index, phrases.filter(n))._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan


def test_buckets_hold_a_bounded_part_of_the_texts(spark, monkeypatch):
    from orderwatch.operators import index as index_module

    monkeypatch.setattr(index_module, "BUCKET_BYTES", 100)
    rows = [(f"c{k:02d}", f"delivery n{k} of gem {'late ' * (k % 4)}", "s", "", "", "paragraph") for k in range(40)]
    written = build_index(spark.createDataFrame(rows, CHUNK_SCHEMA))
    assert written.table("totals").first().n_buckets == 1 + sum(len(r[1]) for r in rows) // 100
    asked = [(1, "late gem"), (2, "n1"), (3, "delivery zzz")]
    found = retrieval.search(open_index(spark, written.path), spark.createDataFrame(asked, "query_id long, query string"), 4)
    assert answers_of(found, asked) == brute_force(rows, asked, 4)


@pytest.mark.parametrize("frequent", [0, 2, 5])
def test_common_and_rare_terms_give_the_same_hits(spark, chunks, queries, monkeypatch, frequent):
    monkeypatch.setattr(retrieval, "FREQUENT", frequent)
    assert answers_of(retrieval.search(chunks, queries, 3), QUERIES) == brute_force(CHUNKS, QUERIES, 3)


def test_vocabulary_shuffles_terms_only(spark):
    """Chunks that come twice, also with a null id, count as one; others are not shuffled to be counted."""
    rows = [("a", "x y x", "x", "", "", "x"), ("a", "y z", "", "", "", ""), (None, "x x", "", "", "", ""), (None, "q", "x", "", "", ""), ("b", "y \u00e9 ???", "e", "", "", ""), ("c", "???", "", "", "", "")]
    posted = retrieval.postings(spark.createDataFrame(rows, CHUNK_SCHEMA))
    found = {(r.term, r.chunk_id, r.field): r.tf for r in posted.collect()}
    assert found == {
        ("x", "a", "text"): 2, ("y", "a", "text"): 2, ("z", "a", "text"): 1, ("x", "a", "source"): 1, ("x", "a", "content_type"): 1,
        ("x", None, "text"): 2, ("q", None, "text"): 1, ("x", None, "source"): 1, ("y", "b", "text"): 1, ("e", "b", "text"): 1, ("e", "b", "source"): 1,
    }
    terms = {r.term: (r.df, r.cf) for r in retrieval.vocabulary(posted).collect()}
    assert terms == {"x": (2, 7), "y": (2, 3), "z": (1, 1), "q": (1, 1), "e": (1, 2)}
    assert terms == {r.term: (r.df, r.cf) for r in retrieval.vocabulary(posted.drop("first")).collect()}
    once = retrieval.postings(spark.createDataFrame([r for r in rows if r[0] in ("b", "c")], CHUNK_SCHEMA))
    once.collect()
    assert retrieval.vocabulary(once).count() == 2
