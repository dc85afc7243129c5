"""Clusters against plain k-means in integers of any size, spelling variants against all pairs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from orderwatch.llm import simplex_clusters, spelling

VECTORS = "vec_id long, embedding array<double>, cluster int, vector string, apex int"


def plain_clusters(rows, k=8, rounds=10, dimensions=64):
    kept = [(i, v) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    points = [[math.floor(Fraction(x) * 1024) for x in v] for _, v in kept]
    centroids = points[:k]

    def assign():
        return [min((sum((x - y) ** 2 for x, y in zip(p, c)), n) for n, c in enumerate(centroids)) for p in points]

    for _ in range(rounds):
        placed = assign()
        for n in range(len(centroids)):
            own = [p for p, (_, c) in zip(points, placed) if c == n]
            if own:
                centroids[n] = [sum(x) // len(own) for x in zip(*own)]
    placed = assign()
    inertia = Counter()
    for d, c in placed:
        inertia[c] += d
    signs = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    fit = lambda v: v if v < 2**63 else None
    return Counter((i, c, fit(d), fit(inertia[c]), fit(sum(inertia.values())), signs[c]) for (i, _), (d, c) in zip(kept, placed))


def got(rows):
    return Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in rows)


def vectors(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, 7, "x", 1) for i, v in rows], VECTORS.replace("double", kind)).repartition(3)


@pytest.fixture(scope="module")
def awkward():
    rng = np.random.default_rng(11)
    rows = [(k, [float(x) for x in rng.normal(size=64) + 4 * (k % 5)]) for k in range(90)]
    rows += [(90, rows[0][1]), (91, rows[0][1]), (3, rows[7][1]), (3, rows[3][1]), (None, rows[9][1]), (None, rows[4][1])]
    return [*rows, (92, None), (93, []), (94, [1.0] * 63), (95, [None] * 64), (96, [math.nan] * 64), (97, [math.inf] * 64), (98, [0.0] * 65)]


def test_clusters_equal_plain_ones(spark, awkward):
    result = simplex_clusters.cluster(vectors(spark, awkward)).collect()
    assert got(result) == plain_clusters(awkward)
    assert sum(r.compared for r in result) < 6 * len(result)  # bounds rule centroids out where there are clusters


def test_clusters_of_huge_components(spark, awkward):
    rows = [*awkward, (200, [1e300] + [0.0] * 63), (201, [-1e300] + [1e-9] * 63), (202, [3e8] * 64), (203, [1.7e308] * 64)]
    assert got(simplex_clusters.cluster(vectors(spark, rows)).collect()) == plain_clusters(rows)


def test_clusters_of_few_floats_and_none(spark, awkward):
    few = [(k, [float(np.float32(x)) for x in v]) for k, v in awkward[:3]]
    assert got(simplex_clusters.cluster(vectors(spark, few, "float")).collect()) == plain_clusters(few)
    same = [(k, few[0][1]) for k in range(20)]
    assert got(simplex_clusters.cluster(vectors(spark, same)).collect()) == plain_clusters(same)
    assert simplex_clusters.cluster(vectors(spark, [])).count() == 0
    assert simplex_clusters.cluster(vectors(spark, awkward[-3:])).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(2)
    for spread in (1, 30, 100_000):
        x = rng.integers(-spread, spread + 1, (300, 64)) * rng.integers(0, 2, 64)
        base = simplex_clusters.simplex(x[:50])
        where, distance, compared = simplex_clusters.nearest(x, base.apexes(x), x[60:75], base.apexes(x[60:75]))
        every = ((x[:, None] - x[None, 60:75]) ** 2).sum(2)
        assert (where == every.argmin(1)).all() and (distance == every.min(1)).all() and compared.min() >= 1


def plain_variants(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    gaps = {}
    for w in counts:  # with one place open or taken out
        for k in range(len(w) + 1):
            gaps.setdefault((w[:k], w[k:], 0), set()).add(w)
            if k < len(w):
                gaps.setdefault((w[:k], w[k + 1 :], 1), set()).add(w)
    near = {w: set() for w in counts}
    for w in counts:
        for k in range(len(w) + 1):
            found = gaps.get((w[:k], w[k:], 1), set())
            if k < len(w):
                found = found | gaps[w[:k], w[k + 1 :], 1] | gaps.get((w[:k], w[k + 1 :], 0), set())
            near[w] |= found - {w}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-counts[o], o.encode()), default=None)
        form[w] = best if best and counts[best] >= 2 * counts[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), counts[form[w]] if form[w] else None) for w, n in counts.items()}


def answers(rows):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_variants_of_all_given_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    result = spelling.variants(docs).collect()
    want = plain_variants([(r.doc_id, r.text) for r in docs.collect()])
    assert answers(result) == want and len(result) == len(want)
    assert any(form for _, form, *_ in want)


def test_variants_of_awkward_rows(spark):
    words = ["letter", "leter", "lettter", "lettre", "latter", "litter", "bitter", "betterr", "école", "École", "ecole", "ecoles", "aaaaa", "aaaaaa", "aaaaab", "xaaaa"]
    texts = [None, "", " 12 !", "ab", "x×y÷z", "LETTER" * 3000]
    texts += [" ".join(w for k, w in enumerate(words) for _ in range(3 + k * n)) for n in range(5)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, texts[-1]), (3, texts[-2]), (3, texts[-2])]
    docs = spark.createDataFrame([(d, t, 1, "w", "r") for d, t in rows], "doc_id long, text string, n long, word string, run string")
    result = spelling.variants(docs).collect()
    assert answers(result) == plain_variants(rows) and len(result) == len(answers(result))
    assert spelling.variants(docs.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [(3, 2), (7, 4), (11, 6)])
def test_every_edit_of_a_word_shares_a_signature(spark, parts):
    rng = np.random.default_rng(parts[0])
    words = {"".join(rng.choice(list("abcde"), int(rng.integers(3, 9)))) for _ in range(150)}
    table = spark.createDataFrame([(w, 1) for w in sorted(words)], "word string, n long")
    found = {(r.word, r.other) for r in spelling.near_pairs(table, *parts).collect()}

    def edits(w):
        for k in range(len(w) + 1):
            yield from (w[:k] + c + w[k:] for c in "abcde")
            if k < len(w):
                yield w[:k] + w[k + 1 :]
                yield from (w[:k] + c + w[k + 1 :] for c in "abcde")

    assert found == {(w, e) for w in words for e in edits(w) if e in words and e != w}
