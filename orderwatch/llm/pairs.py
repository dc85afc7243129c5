"""Distinct shingle sets and exact comparisons of pairs of them, for joins on set similarity.

Rows with equal sets are one class; a class has a number (``node``) that is written once
and read back, so every later job sees the same numbers. Copies of a text are
never paired with each other.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import mix, rows_of, shingle_set, stored, whole_text, word_hashes

ODD_WORDS = 16
FILTER_BITS = 1 << 23
HOT_SHARE = 1000


def set_key(tokens: np.ndarray) -> bytes | None:
    """A 128-bit hash that equal sets share; None for the empty set."""
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest() if len(tokens) else None


def odd_cells(tokens: np.ndarray) -> bytes:
    """For each of 64 * ODD_WORDS cells of the hash space whether it holds an odd number of tokens."""
    cells = (mix(tokens) % np.uint64(64 * ODD_WORDS)).astype(np.int64)
    return np.packbits(np.bincount(cells, minlength=64 * ODD_WORDS).astype(np.uint8) & 1).tobytes()


ODD_NAMES = [f"odd_{k}" for k in range(ODD_WORDS)]


def odd_columns(parts: list[bytes]) -> list[pa.Array]:
    words = np.frombuffer(b"".join(parts), np.int64).reshape(-1, ODD_WORDS)
    return [pa.array(words[:, k]) for k in range(ODD_WORDS)]


def sizes_fit(a: str, b: str, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def cells_fit(a: str, b: str, suffix: str, percent: int) -> Column:
    """Whether sets of sizes ``a`` and ``b`` may be similar: they differ by a token at least in each cell whose oddness differs."""
    apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(c + suffix))) for c in ODD_NAMES), F.lit(0))
    sizes = F.col(a) + F.col(b)
    # Shared tokens are (sizes - different) / 2 at most; compared as 100 * shared >= percent * (sizes - shared).
    return (100 + percent) * (sizes - apart) >= 2 * percent * sizes


def ordered(frame: DataFrame) -> DataFrame:
    return frame.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def join_hot(rows: DataFrame, classes: DataFrame, key: str, copies: str) -> DataFrame:
    """``rows`` left-joined with ``classes``, which has one row for each key and its number of rows in ``copies``.

    Keys of more than a thousandth of all rows, of which there are fewer than a thousand, are
    joined by broadcast; so no task has to take all rows of such a key. Rows without
    a key take no part in the join.
    """
    total = classes.agg(F.sum(copies)).first()[0] or 0
    classes = classes.filter(F.col(key).isNotNull())
    hot = F.col(copies) * HOT_SHARE > total
    often, rest = F.broadcast(classes.filter(hot).drop(copies)), classes.filter(~hot).drop(copies)
    added = [F.lit(None).cast(kind).alias(c) for c, kind in rest.dtypes if c != key]
    keyed = rows.filter(F.col(key).isNotNull())
    usual = keyed.join(F.broadcast(often.select(key)), key, "left_anti").join(rest, key, "left")
    return keyed.join(often, key).unionByName(usual).unionByName(rows.filter(F.col(key).isNull()).select("*", *added))


def shared_ids(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (a, b) between the sets of rows that share an id; ``rows`` has doc_id and key."""
    # Ids with one set, nearly all, leave before the join; copies of a set leave within each task.
    known = rows.filter("key is not null and doc_id is not null").select("doc_id", "key").distinct()
    several = known.groupBy("doc_id").agg(F.min("key").alias("low"), F.max("key").alias("high")).filter("low != high")
    linked = known.join(several, "doc_id").filter("key != low").select(F.col("low").alias("x"), F.col("key").alias("y"))
    numbers = [classes.select(F.col("key").alias(k), F.col("node").alias(n)) for k, n in (("x", "a"), ("y", "b"))]
    return stored(linked.join(numbers[0], "x").join(numbers[1], "y").select("a", "b"), "same-id")


def needed_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, packed) of the wanted documents and a few others: their texts, compressed, each text of an id once.

    A bit field of fixed size over the ids' hashes spares the rest; the exact choice is
    left to the joins that follow.
    """
    bit = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(FILTER_BITS))
    fields = ids.select(F.shiftright(bit, 6).cast("int").alias("at"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id), {FILTER_BITS}L) % 64 as int))").alias("bit"))
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    for row in fields.groupBy("at").agg(F.bit_or("bit").alias("bits")).collect():  # at most FILTER_BITS / 64 rows
        bits[row.at] = row.bits
    field = docs.sparkSession.sparkContext.broadcast(bits)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column("place").to_numpy(zero_copy_only=False)
            wanted = np.flatnonzero((field.value[place // 64] >> (place % 64)) & 1)
            for at in range(0, len(wanted), 256):
                part = batch.take(pa.array(wanted[at : at + 256]))
                plain = [t.encode() for t in rows_of(part, "text")]
                marks = [int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "little", signed=True) for t in plain]
                packed = [zlib.compress(t, 1) for t in plain]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(marks, pa.int64()), pa.array(packed, pa.binary())], ["doc_id", "mark", "packed"])

    rows = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), whole_text())
    return rows.withColumn("place", bit).mapInArrow(texts, "doc_id long, mark long, packed binary").dropDuplicates(["doc_id", "mark"]).drop("mark")


def exact_links(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets are similar enough; ``classes`` has node, key and doc_id."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    needed = stored(classes.select("node", "key", "doc_id").join(nodes, "node"), "needed")
    texts = needed_texts(docs, needed.select("doc_id")).join(needed, "doc_id").select("node", "key", "packed")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lately: dict[bytes, np.ndarray] = {}

        def tokens(packed: bytes) -> np.ndarray:
            if packed not in lately:
                if len(lately) >= 32:
                    lately.clear()
                lately[packed] = shingle_set(word_hashes(zlib.decompress(packed).decode()), words)
            return lately[packed]

        for batch in batches:
            linked = []
            for x, y, key_x, key_y in zip(*(rows_of(batch, c) for c in ("x", "y", "key_x", "key_y"))):
                x, y = tokens(x), tokens(y)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                similar = 100 * shared >= percent * (len(x) + len(y) - shared)
                # Another text of the same id has another key.
                linked.append(similar and set_key(x) == key_x and set_key(y) == key_y)
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    left, right = (texts.select(F.col("node").alias(n), F.col("packed").alias(t), F.col("key").alias(f"key_{t}")) for n, t in (("a", "x"), ("b", "y")))
    return pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(compare, "a long, b long").distinct()


def answers(rows: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n, component_id) of each row (doc_id, n, key): the smallest id of its component, its own for an empty set.

    ``classes`` has node, key, doc_id (the smallest of the class) and copies, ``labels`` node and component.
    """
    grouped = stored(classes.join(labels, "node", "left").select("key", "doc_id", "copies", F.coalesce("component", "node").alias("component")), "grouped")
    roots = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("sets"))
    ends = stored(join_hot(grouped, roots, "component", "sets").select("key", "component_id", "copies"), "ends")
    # A row without an id has no component; its copies with an id keep theirs.
    found = join_hot(rows.withColumn("key", F.when(F.col("doc_id").isNotNull(), F.col("key"))), ends, "key", "copies")
    return found.select("doc_id", "n", F.coalesce("component_id", "doc_id").alias("component_id"))


def close(linked: DataFrame) -> DataFrame:
    """Labels of the components of edges (a, b); none without an edge."""
    if linked.limit(1).count():
        return components(linked)
    return linked.sparkSession.createDataFrame([], "node long, component long")
