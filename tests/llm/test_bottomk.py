"""Bottom-k links against all pairs, in any order of rows and with ids that repeat."""

from __future__ import annotations

import itertools
import random
import re

import pytest

from orderwatch.llm import bottomk, ngram_join, pairs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, node long, n long, key string, retained int, component long"


def shingles(text, n=5):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def plain(rows, percent=85, n=5):
    """(id, set size, component, kept) of each row; rows of one id are one document."""
    sets = [(k, shingles(t, n)) for k, t in rows]
    root = {k: k for k, _ in rows if k is not None}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in itertools.combinations([x for x in sets if x[0] is not None and x[1]], 2):
        if 100 * len(a & b) >= percent * len(a | b):
            low, high = sorted((top(i), top(j)))
            root[high] = low
    return sorted((k is None, k or 0, len(s), None if k is None else top(k), k is not None and top(k) == k) for k, s in sets)


def got(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in df.collect())


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(k, t, 1, 2, "k", 3, 4) for k, t in rows], SCHEMA).repartition(parts)


def prose(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def edited(rng, base, share):
    return [f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in base]


@pytest.mark.parametrize("percent", [80, 85])
def test_links_equal_all_pairs(spark, percent):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert got(bottomk.link(frame(spark, rows), percent=percent)) == plain(rows, percent)


@pytest.mark.parametrize("retained", [16, 96])
def test_groups_of_near_copies(spark, retained):
    """Chains, large groups just above and below the limit, short and contained sets, and one passage in all."""
    rng = random.Random(4)
    passage, rows = prose(rng, 60), []
    for size in (40, 150, 700):
        base = prose(rng, size)
        rows += [" ".join(edited(rng, base, rng.choice([0, 0.005, 0.015, 0.03]))) for _ in range(25)]
        rows += [" ".join(passage + prose(rng, size // 4)) for _ in range(10)]
    short = prose(rng, 14)
    rows += [" ".join(short[a:b]) for a in range(4) for b in range(a + 1, 15)]
    rows = list(enumerate(rows))
    rng.shuffle(rows)
    assert got(bottomk.link(frame(spark, rows), retained=retained)) == plain(rows)


def test_repeated_ids_in_every_order(spark):
    rng = random.Random(9)
    base, other = prose(rng, 120), prose(rng, 60)
    rows = [(1, " ".join(base)), (2, " ".join(base[6:])), (2, " ".join(other)), (3, " ".join(other[3:]))]
    third = [*rows, (2, " ".join(prose(rng, 30))), (4, " ".join(prose(rng, 30)))]
    third.append((5, third[-2][1].upper()))
    for order in [rows, rows[::-1], [rows[2], rows[0], rows[3], rows[1]], third, third[::-1]]:
        assert got(bottomk.link(frame(spark, order, 1))) == plain(order)


def test_prefix_join_with_repeated_ids_in_every_order(spark):
    rng = random.Random(9)
    base, other = prose(rng, 120), prose(rng, 60)
    rows = [(1, " ".join(base)), (2, " ".join(base[6:])), (2, " ".join(other)), (3, " ".join(other[3:])), (2, " ".join(prose(rng, 30)))]
    for order in (rows, rows[::-1], [rows[k] for k in (2, 4, 0, 3, 1)]):
        result = ngram_join.link(frame(spark, order, 1)).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in result) == [x[1:4] for x in plain(order, 85, 4)]


def test_prefix_join_of_groups_of_near_copies(spark):
    """Groups around the limit, where pairs meet in many buckets and most are not linked."""
    rng = random.Random(14)
    rows = []
    for size in (30, 140, 600):
        base = prose(rng, size)
        rows += [" ".join(edited(rng, base, rng.choice([0.005, 0.02, 0.03, 0.05]))) for _ in range(30)]
    rows = list(enumerate(rows))
    result = ngram_join.link(frame(spark, rows), words=5, percent=80).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in result) == [x[1:4] for x in plain(rows, 80)]


def test_awkward_rows(spark):
    long = " ".join(f"word{k % 5000}" for k in range(60_000))
    rows = [(None, None), (None, long), (0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "ONE"), (5, "one two"), (6, long), (7, long + " more"), (6, long), (8, "é 中文 🙂 ok ok")]
    assert got(bottomk.link(frame(spark, rows))) == plain(rows)
    assert bottomk.link(frame(spark, rows).limit(0)).count() == 0
    assert got(bottomk.link(frame(spark, rows[:3]))) == plain(rows[:3])


def test_least_shared_bounds_the_loss():
    rng = random.Random(1)
    k = 64
    bound = bottomk.least_shared(k, 85, 1e-4)
    lost = sum(sum(rng.random() < 0.85 for _ in range(k)) < bound for _ in range(20_000))
    assert lost <= 8 and bottomk.least_shared(k, 85, 1e-9) < bound < 0.85 * k
    assert bottomk.least_shared(4, 100) == 4


def test_hot_keys_join_once(spark):
    rows = spark.createDataFrame([("hot", k) for k in range(3000)] + [(f"k{k}", k) for k in range(50)] + [(None, 7)], "key string, v int")
    classes = spark.createDataFrame([("hot", 3000, 1), *[(f"k{k}", 1, 2) for k in range(49)]], "key string, copies long, about int")
    joined = pairs.join_hot(rows, classes, "key", "copies")
    assert joined.count() == rows.count() and joined.filter("about is null").count() == 2
    assert joined.filter("about = 1").count() == 3000
