"""Helpers that several operators use: folders, folds, word hashes, batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_path

# Fixed values of the 64-bit finisher and of the polynomial word hash.
MIX_1, MIX_2, STEP = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15
BASE = 0x5851F42D4C957F2D
PIECE_BYTES = 1 << 20

_SPACE = bytes([32, 9, 10, 11, 12, 13])
_IS_WORD = np.ones(256, np.int8)
_IS_WORD[list(_SPACE)] = 0
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_powers: dict[str, np.ndarray] = {}


def text_batches(spark: SparkSession, rows: int = 512) -> None:
    """Hand texts to Python in small batches: Spark's default of 10,000 rows is made for short values.

    The setting stays with the session; a smaller one is left as it is.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later jobs start from the files."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(modulus: int, key: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``modulus``; a NULL id counts as empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus


def whole_text() -> Column:
    return F.coalesce(F.col("text"), F.lit("")).alias("text")


def rows_of(batch: pa.RecordBatch, column: str) -> Iterator:
    """The values of a column one by one, without a list of all."""
    for value in batch.column(column):
        yield value.as_py()


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(MIX_1)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(MIX_2)
    return h ^ (h >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64, at least ``n`` of them."""
    if not _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 14)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.cumprod(table, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def word_places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First bytes and 64-bit hashes of the words of a byte string."""
    codes = np.frombuffer(data, np.uint8)
    edge = np.diff(_IS_WORD[codes], prepend=np.int8(0), append=np.int8(0))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _power_tables(len(codes) + 1)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes + np.uint64(1)) * up[: len(codes)], out=total[1:])
    return first, mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64) * np.uint64(STEP))


def pieces(data: bytes, size: int = PIECE_BYTES) -> Iterator[bytes]:
    """``data`` in parts of about ``size`` bytes, cut only at white space."""
    at = 0
    while len(data) - at > size:
        cut = max(data.rfind(s, at + 1, at + size) for s in (b" ", b"\n", b"\t"))
        if cut <= at:
            after = [x for x in (data.find(s, at + size) for s in (b" ", b"\n", b"\t")) if x >= 0]
            cut = min(after, default=len(data))
        yield data[at:cut]
        at = cut
    yield data[at:]


def lower(text: str) -> bytes:
    """A text's bytes with A-Z lower-cased."""
    return text.encode().translate(_LOWER)


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the lower-cased words ``[^\\x20\\x09-\\x0D]+`` of a text, in order.

    Only A-Z are lower-cased. No text or no word: an empty array. Two different
    words share a hash with a chance of about 2**-64.
    """
    if not text:
        return np.zeros(0, np.uint64)
    parts = [word_places(p)[1] for p in pieces(lower(text))]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles; all words as one if there are fewer."""
    if not len(words):
        return words
    n = min(n, len(words))
    h = words[: len(words) - n + 1].copy()
    for k in range(1, n):
        h = h * np.uint64(BASE) + words[k : len(words) - n + 1 + k]
    return np.unique(mix(h + np.uint64(n)))
