"""Each operator on awkward rows, empty tables and against plain versions."""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from orderwatch.llm import byte_cnn, decontaminate, hilbert, license_rules, lm, ngram_join, quality_model, quality_rules, token_index
from orderwatch.llm.queries import TOKENIZER
from orderwatch.llm.shared import new_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row long, n long, kept boolean, node long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PROSE = "the quick brown fox jumps over the lazy dog while many small birds sing in the old garden near our house and the river flows past it"
ITEM = "a benchmark question about seven green bottles standing on a wall and what happens once one of them falls down by accident"


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


@pytest.fixture(scope="module")
def docs(spark):
    copy = PROSE + " now"
    texts = [None, "", " \n\t", PROSE, PROSE, PROSE.upper(), copy, "short", "12 !!", ("mot " + PROSE + "\n") * 900, ITEM + " " + PROSE, "é中文 🙂"]
    rows = [(k, t, None if k == 3 else "en", "s", 1, 0.5, 1, 1, True, 1) for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[3], rows[6]], SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="module")
def tables(spark):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(12)] + [(3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    return labels, spark.createDataFrame([(1, ITEM), (2, None), (3, "tiny")], "item_id long, text string")


def test_every_row_is_answered(spark, docs, empty, tables):
    labels, benchmark = tables
    operators = {
        "quality": lambda d: quality_model.score(d, quality_model.fit(d, labels)),
        "language": lambda d: byte_cnn.predict(d, byte_cnn.fit(d)),
        "lm": lm.score,
        "licence": license_rules.recognise,
        "join": ngram_join.link,
        "shards": hilbert.shard,
        "benchmark": lambda d: decontaminate.find(d, benchmark),
        "rules": quality_rules.judge,
    }
    for name, operator in operators.items():
        got = sorted(r.doc_id for r in operator(docs).select("doc_id").collect())
        assert got == sorted([*range(12), 3, 6]), name
        assert operator(empty).count() == 0, name


def test_token_index(spark, docs, empty):
    path = new_path(spark, "shards")
    token_index.write_shards(docs, path, TOKENIZER, shard_ids=50)
    rows = sorted(token_index.read_documents(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted([*range(12), 3, 6])
    assert all(a.start + a.n_tokens == b.start for a, b in itertools.pairwise(rows))
    assert rows[0].n_tokens == 1 and rows[0].ids_crc32 == zlib.crc32(bytes(4))
    found = token_index.lookup(spark, path, [3, 6, 7, 99, -5]).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in found} == {3: 2, 6: 2, 7: 1}
    none = new_path(spark, "shards")
    token_index.write_shards(empty, none, TOKENIZER)
    assert token_index.read_documents(spark, none).count() == 0


def test_token_index_equals_the_library(spark, small):
    """Starts, lengths and checksums of all rows, with ids that repeat in any row order."""
    import numpy as np
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(TOKENIZER)
    rows = [(r.doc_id, r.text) for r in small.collect()] + [(3, "one more"), (3, "and more"), (None, "no id"), (None, None)]
    results = []
    for order in (rows, rows[::-1]):
        path = new_path(spark, "shards")
        token_index.write_shards(spark.createDataFrame(order, "doc_id long, text string").repartition(3), path, TOKENIZER, shard_ids=3000)
        results.append(sorted(token_index.read_documents(spark, path).collect(), key=lambda r: r.start))
    assert results[0] == results[1]
    assert [r.doc_id for r in results[0][:2]] == [None, None]
    assert [r.doc_id for r in results[0]] == sorted((d for d, _ in rows), key=lambda d: -1 if d is None else d)
    ids = {(d, t): np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for d, t in rows}
    want = Counter((d, len(x), zlib.crc32(x.tobytes())) for (d, _), x in ids.items())
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in results[0]) == want
    start = 0
    for r in results[0]:
        assert r.start == start
        start += r.n_tokens


def test_join_equals_all_pairs(small):
    rows = {r.doc_id: r.text for r in small.collect()}
    sets = {}
    for k, text in rows.items():
        w = words(text)
        sets[k] = {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()
    root = {k: k for k in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(rows), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            low, high = sorted((top(a), top(b)))
            root[high] = low
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link(small).collect()}
    assert got == {k: (len(sets[k]), top(k)) for k in rows}


def test_signatures_meet_whatever_is_frequent():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(8, 400))
        a = np.unique(rng.integers(0, 2**63, n, np.uint64))
        lose = int(rng.integers(0, ngram_join.missing(len(a), 85) // 2 + 1))
        b = np.unique(np.concatenate([rng.permutation(a)[lose:], rng.integers(0, 2**63, lose, np.uint64)]))
        frequent = np.sort(rng.permutation(np.union1d(a, b))[: int(rng.integers(0, 2 * n))])
        shared = len(np.intersect1d(a, b))
        if lose and 100 * shared >= 85 * (len(a) + len(b) - shared):
            assert len(np.intersect1d(ngram_join.signatures(a, frequent, 85), ngram_join.signatures(b, frequent, 85)))
            assert ngram_join.possible(ngram_join.sketch(a), ngram_join.sketch(b), 85)


def test_signatures_of_contained_sets_meet():
    import numpy as np

    rng, linked = np.random.default_rng(5), 0
    for percent, n, m, _ in itertools.product((80, 85, 90), range(1, 11), range(1, 11), range(20)):
        b = np.unique(rng.integers(0, 2**63, max(n, m), np.uint64))
        a = np.sort(rng.permutation(b)[: min(n, m)])
        frequent = np.sort(rng.permutation(b)[: int(rng.integers(0, len(b) + 1))])
        if len(a) < len(b) and 100 * len(a) >= percent * len(b):
            linked += 1
            assert len(np.intersect1d(ngram_join.signatures(a, frequent, percent), ngram_join.signatures(b, frequent, percent))), (percent, len(a), len(b))
    assert linked > 300


def test_short_texts_with_a_word_more_are_linked(spark):
    text = " ".join(f"w{k}" for k in range(9))
    rows = [(1, text), (2, text + " more"), (3, "less " + text), (4, " ".join(f"v{k}" for k in range(9)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.link(docs).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_lm_base_is_exact(small):
    import math

    rows = {r.doc_id: words(r.text) + ["\0"] for r in small.collect()}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in rows}
    counts = Counter(w for k, ws in rows.items() if not held[k] for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    got = lm.score(small).collect()
    for r in got:
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in rows[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(rows[r.doc_id]), sum(counts[w] > 0 for w in rows[r.doc_id]), total, held[r.doc_id])
        assert r.base_score == pytest.approx(base, rel=1e-9)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_lm_hot_pairs_are_split(spark, monkeypatch):
    rows = [(k, "the " * 500 + f"end{k % 3} of it") for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    want = {r.doc_id: r for r in lm.score(docs).collect()}
    monkeypatch.setattr(lm, "HOT_EVENTS", 1000)
    monkeypatch.setattr(lm, "GROUP_TOKENS", 6000)
    for r in lm.score(docs).collect():
        assert (r.n_tokens, r.n_known, r.train_tokens) == (want[r.doc_id].n_tokens, want[r.doc_id].n_known, want[r.doc_id].train_tokens)
        assert (r.base_score, r.score) == (pytest.approx(want[r.doc_id].base_score, rel=1e-9), pytest.approx(want[r.doc_id].score, rel=1e-9))
    counts, _ = lm.count(docs)
    counts = lm.hot_pairs(docs, counts, 60480)
    sizes = lm._events(docs, counts, 10).groupBy("group").agg((F.sum(F.length("docs")) / 2).alias("n")).collect()
    assert max(r.n for r in sizes) < 30000


def test_each_licence_sentence_and_rule_is_recognised(spark):
    names = list(license_rules.SENTENCES)
    texts = [license_rules.SENTENCES[n].upper() for n in names]
    texts += [". ".join(license_rules.SENTENCES[n] for n in ids) for _, _, ids in license_rules.RULES]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in license_rules.recognise(rows).collect()}
    assert [got[k].sentences for k in range(len(names))] == names
    for k, (rule, licence, ids) in enumerate(license_rules.RULES, len(names)):
        assert (got[k].n_known, got[k].sentences, got[k].rules, got[k].licences) == (len(ids), ",".join(ids), rule, licence)


def test_quality_counts(docs):
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in quality_rules.judge(docs).collect():
        w = WORD.findall(texts[r.doc_id])
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {i + j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(8)}
        lines = [x for x in texts[r.doc_id].split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in texts[r.doc_id]), len(lines) - len(set(lines)), len(hit))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 20 or 100 * len(hit) > 30 * len(w)) and not (r.base_failed and r.kept)


def test_hilbert(spark, small):
    axes = spark.range(512).select(*[(F.shiftright("id", 3 * k).bitwiseAND(F.lit(7))).alias(f"a{k}") for k in range(3)])
    path = sorted(axes.withColumn("i", hilbert.hilbert_index([F.col(f"a{k}") for k in range(3)], 3)).collect(), key=lambda r: r.i)
    assert [r.i for r in path] == list(range(512))
    assert all(sum(abs(x - y) for x, y in zip(a[:3], b[:3])) == 1 for a, b in itertools.pairwise(path))
    rows = hilbert.shard(small, 7).collect()
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert {(r.shard, r.slot) for r in rows} == {(s, k) for s, n in sizes.items() for k in range(n)}


def test_edited_items_are_found():
    import random

    rng, found = random.Random(4), 0
    items = [(k, " ".join(rng.choice(PROSE.split()) + rng.choice("xyz") * rng.randint(0, 2) for _ in range(40)).encode()) for k in range(60)]
    finder = decontaminate.Finder(items)
    for k, item in items:
        data = bytearray(item)
        for _ in range(len(data) // 20):
            data[rng.randrange(len(data))] = rng.randrange(97, 123)
        found += any(h[0] == k for h in finder.hits([PROSE + " " + data.decode() + " " + PROSE])[0])
    assert found >= 54
    assert finder.hits([PROSE, ""]) == [[], []]


def test_exact_copies_of_any_length_are_found():
    import random

    rng = random.Random(9)
    for n in range(1, 20):
        made = ("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in itertools.count())
        items = [(k, " ".join(next(made) for _ in range(n)).encode()) for k in range(100)]
        finder = decontaminate.Finder(items)
        before, after = (" ".join(next(made) for _ in range(20)) for _ in range(2))
        hits = finder.hits([f"{before} {i.decode()} {after}" for _, i in items] + [f'{before} "{i.decode()}." {after}' for _, i in items])
        assert all((k % 100, 0) in h for k, h in enumerate(hits)), n


def test_short_items():
    items = [(1, b"sun"), (2, b"blue river"), (3, b"who wrote the old song"), (4, b"   "), (5, "日本語の長い質問文です".encode())]
    hits = decontaminate.Finder(items).hits
    assert hits(["the SUN, now", "sunny unsung", "sun", ""]) == [[(1, 0)], [], [(1, 0)], []]
    assert hits(["a blue rivet", "a blux river", "a blux rivet", "at blueriver"]) == [[(2, 1)], [(2, 1)], [], [(2, 1)]]
    assert hits(["he asked who wrote the old song?", "前文日本語の長い質問文です後文", "    "]) == [[(3, 0)], [(5, 0)], []]


def test_short_items_reach_the_table(spark, docs):
    benchmark = spark.createDataFrame([(1, "river flows past"), (2, "short"), (3, None), (4, " ")], "item_id long, text string")
    got = {r.doc_id: r["items"] for r in decontaminate.find(docs, benchmark).collect()}
    assert got == {k: [1] if k in (3, 4, 5, 6, 9, 10) else [2] if k == 7 else [] for k in range(12)}


def test_pipeline_drops_near_copies_on_five_words(spark):
    # 40 of 50 five-word shingles are shared, and 41 of 51 four-word shingles.
    text, other = (" ".join(f"{c}{k}" for k in range(54)) for c in "ab")
    rows = [(1, " ".join(text.split()[:44])), (2, text), (3, other), (4, " ".join(other.split()[:43]))]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]


def test_pipeline_stages(spark, docs, empty, tmp_path):
    benchmark = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
        if name != "bpe":
            assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
    kept = {n: sorted(r.doc_id for r in s(spark, docs, str(tmp_path)).collect()) for n, s in corpus_pipeline.STAGES if n in ("ngram_join", "decontaminate")}
    assert kept["ngram_join"] == [0, 1, 2, 3, 7, 8, 10, 11]  # 9 repeats the text of 3
    assert 10 not in kept["decontaminate"] and len(kept["decontaminate"]) == 13
