"""What the fits of the two classifiers bring to the driver, their forward passes against plain ones, and the weights of the language model."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest

from orderwatch.llm import byte_cnn, lm, quality_model


@pytest.fixture(scope="module")
def rows():
    return [(k, f"text number {k} with words {'good ' * (k % 2)}{'bad ' * (1 - k % 2)}", "ab"[k % 2] * 2) for k in range(40)]


def test_an_id_that_repeats_counts_once(spark, rows):
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    repeated = rows + [rows[3]] * 500
    models = [quality_model.fit(spark.createDataFrame(r, "doc_id long, text string, lang string"), labels) for r in (rows, repeated, repeated[::-1])]
    assert all(np.array_equal(models[0].gain, m.gain) for m in models)
    nets = [byte_cnn.fit(spark.createDataFrame(r, "doc_id long, text string, lang string")) for r in (rows, repeated, repeated[::-1])]
    assert all(np.array_equal(nets[0].layer, n.layer) for n in nets)


def test_every_language_is_learned(spark):
    alphabet = [chr(0x61 + k % 26) + chr(0xE0 + k % 24) for k in range(70)]
    rows = [(k, (alphabet[k % 70] + " ") * 60, f"l{k % 70:02d}") for k in range(700)]
    net = byte_cnn.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_lang=5)
    assert list(net.langs) == sorted({r[2] for r in rows})


def test_few_documents_are_ranked(spark, rows, monkeypatch):
    """A bound on the hashes changes which rows are ranked, not which are taken."""
    df = spark.createDataFrame([(k, t, "one") for k, (_, t, _) in enumerate(rows * 20)], "doc_id long, text string, lang string")
    wanted = byte_cnn.fit(df, per_lang=20)
    monkeypatch.setattr(byte_cnn, "SPARE", 10**6)
    assert np.array_equal(wanted.layer, byte_cnn.fit(df, per_lang=20).layer)


def test_convolution_equals_a_plain_one(spark, rows):
    net = byte_cnn.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    windows = np.random.default_rng(1).integers(0, 256, (5, byte_cnn.WINDOW)).astype(np.uint8)
    got = byte_cnn.chances(net, net.tables(), windows)
    for window, chance in zip(windows, got):
        embedded, pooled = net.embed[window], []
        for width, filters, bias in zip(byte_cnn.WIDTHS, net.filters, net.offsets):
            places = [embedded[k : k + width].ravel() for k in range(len(window) - width + 1)]
            pooled.append(np.maximum((np.array(places) @ filters + bias).max(0), 0))
        odds = np.concatenate(pooled) @ net.layer + net.bias
        plain = np.exp(odds - odds.max())
        assert np.allclose(chance, plain / plain.sum(), atol=1e-5)


def test_mixture_weights_are_learned_from_all_training_events(spark):
    rows = [(k, " ".join(f"w{(k * j) % 23} w{(k + j * j) % 31}" for j in range(40)), "aa") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    counts, _ = lm.count(docs)
    taught = [r[1].split() for r in rows if zlib.crc32(str(r[0]).encode()) % 5 != 1]
    events = [e for words in taught for e in zip([None, *words], [*words, None])]
    tokens, contexts, pairs = Counter(e[1] for e in events), Counter(e[0] for e in events), Counter(events)
    want, total, none = np.tile([0.1, 0.6, 0.3], (64, 1)), len(events), 1 / (len(tokens) + 1)

    def step(count, size):
        return 2 ** (round(lm.STEPS * np.log2((count - 1) / max(size - 1, 1))) / lm.STEPS) if count > 1 else 0.0

    cells = {}
    for before, word in events:
        size = contexts[before]
        cells.setdefault(int(np.log2(size)), []).append([none, step(tokens[word], total), step(pairs[before, word], size)])
    for bucket, chances in cells.items():
        chances = np.array(chances)
        for _ in range(lm.EM_ROUNDS):
            share = chances * want[bucket]
            want[bucket] = (share / share.sum(1, keepdims=True)).sum(0) / len(chances)
        want[bucket] = (want[bucket] * len(chances) + 1 / 3) / (len(chances) + 1)
    for groups in (1, 3):
        kept = lm._events(docs, counts, groups)
        assert np.allclose(lm.learn(kept, counts), want, rtol=1e-6)
