"""Tree concatenation against the library, on texts made to break joins."""

from __future__ import annotations

import random
from array import array

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from orderwatch.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
BITS = ["a", "ab", "the ", "theta", "'", "'s", "'ll", "l", " ", "  ", "\n", "\n\n", "\t", "1", "23", "!", "!!", "é", "中文", "🙂", " ", "　",
        "\x1c", "\x85", "́", "<|endoftext|>", "<|end", "aaaaaaaa", "    ", "----", " A", "'S", "ing", "tion", "0000", "‍"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids(data: bytes) -> list[int]:
    return [int.from_bytes(data[k : k + 4], "little") for k in range(0, len(data), 4)]


@pytest.mark.parametrize("leaf", [1, 2, 3, 7, 40])
def test_tree_equals_library(library, monkeypatch, leaf):
    monkeypatch.setattr(bpe, "LEAF_CHARS", leaf)
    coder, rng = bpe.Coder(PATH), random.Random(leaf)
    for _ in range(400):
        pool = rng.sample(BITS, rng.randint(1, len(BITS)))
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 60)))
        found = coder.encode(text)
        assert ids(found) == library.encode(text, add_special_tokens=False).ids, repr(text)
        assert coder.decode(found) == text


def test_long_runs(library, monkeypatch):
    monkeypatch.setattr(bpe, "LEAF_CHARS", 64)
    coder = bpe.Coder(PATH)
    rng = random.Random(5)
    for text in ["a" * 5000, " " * 3001 + "x", "ab" * 2000, "".join(rng.choice("abcde") for _ in range(6000)), "=" * 4097, "中" * 2000, "\n" * 999, "7" * 3000]:
        assert ids(coder.encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_operator_handles_edges(spark, library, monkeypatch):
    long = "the quick onnthe reeder's " * 9000 + "<|endoftext|>" + "x" * 70000
    rows = [(1, None, 1), (2, "", 2), (3, "hello world", 3), (3, "hello world", 3), (None, "a'll <|endoftext|> b", 4), (5, long, 5), (5, long, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    out = bpe.digests(bpe.decode(bpe.encode(docs, PATH), PATH)).collect()
    assert len(out) == len(rows)
    for doc_id, text, _ in rows:
        want = library.encode(text or "", add_special_tokens=False).ids
        assert any(r.doc_id == doc_id and r.n_tokens == len(want) for r in out)
    back = bpe.decode(bpe.encode(docs, PATH), PATH).filter(F.col("doc_id") == 5).collect()
    assert [r.text for r in back] == [long, long]
    assert ids(back[0].ids) == library.encode(long, add_special_tokens=False).ids


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert bpe.digests(bpe.decode(bpe.encode(docs, PATH), PATH)).count() == 0


def test_bytes_that_are_no_text(spark, library):
    broken = spark.createDataFrame([(1, bytearray((233).to_bytes(4, "little") * 2))], "doc_id long, ids binary")
    assert bpe.decode(broken, PATH).first().text == library.decode([233, 233], skip_special_tokens=False)


def test_odd_neighbours_are_encoded_as_the_library_does():
    """Blanks, quotes, digits, signs and special strings side by side."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, rng = Tokenizer.from_file(path), random.Random(6)
    parts = ["  ", "\n\n a", "a", "\u3000b", "'s", " 's", "  12ab", "\u00e9 ", "x\t\ty<|endoftext|>  z", " \U0001f642", " word", "-", " $"]
    code = bpe.Coder(path)
    for _ in range(2000):
        text = "".join(rng.choices(parts, k=rng.randrange(1, 12)))
        assert list(array("I", code.encode(text))) == library.encode(text, add_special_tokens=False).ids
