"""Quality classifier with subword embeddings.

Every word and every run of 3 and 4 bytes of a text is hashed to a row of an embedding
table; each pair of neighbouring words adds a row for its shape (two words, or one
twice), which carries over to words never seen. A document is the mean of its vectors, a softmax layer turns it into class
probabilities, and table and layer are learned together by stochastic gradient
descent in numpy. Hashing is on bytes and keeps case, so shouting, symbols and
repeated words all leave their mark.

Learning uses a bounded sample: the ``sample`` labelled documents outside the held-out
fold that come first in the order of their id's hash. Only hashed counts of their whole
texts reach the driver. Scoring reads every text in its own task: the layer is
linear, so each table row adds one number to the mean.

Defined results: NULL and empty texts have no features and get the score of the bias; with
no labelled document, or one class only, every score is that class's share (0.5 without
any); of several labels of one id the highest counts, NULL labels none; repeated rows are
scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import fold, pieces, rows_of, text_batches, whole_text, word_places

BUCKET_BITS = 16
DIM = 16
SAMPLE = 3000
EPOCHS = 4
RATE = 0.5
GRAMS = (3, 4)
SLICE_BYTES = 1 << 19
# Table rows of the two shapes of a word pair: two different words, one word twice.
SHAPES = np.array([1, 2])


def features(text: str) -> Iterator[np.ndarray]:
    """Table rows of all words and byte runs of a text, a slice at a time."""
    data = text.encode()
    before = np.zeros(0, np.uint64)
    for piece in pieces(data, SLICE_BYTES):
        words = word_places(piece)[1]
        yield (words >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        run, before = np.concatenate([before, words]), words[-1:] if len(words) else before
        yield SHAPES[(run[1:] == run[:-1]).astype(np.int64)]
    codes = np.frombuffer(data, np.uint8)
    for n in GRAMS:
        for at in range(0, len(codes) - n + 1, SLICE_BYTES):
            part = codes[at : at + SLICE_BYTES + n - 1].astype(np.uint32)
            run = np.full(len(part) - n + 1, n, np.uint32)
            for k in range(n):
                run = run * np.uint32(0x01000193) ^ part[k : len(part) - n + 1 + k]
            yield (run * np.uint32(0x9E3779B1) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    total = np.zeros(1 << BUCKET_BITS, np.int64)
    for found in features(text):
        total += np.bincount(found, minlength=len(total))
    rows = np.flatnonzero(total)
    return rows.astype("<u4"), total[rows].astype("<u4")


@dataclass
class Model:
    """``table`` and ``layer`` as learned; ``gain`` is what each row adds to the log odds."""

    table: np.ndarray
    layer: np.ndarray
    bias: np.ndarray

    @property
    def gain(self) -> np.ndarray:
        return (self.table @ (self.layer[:, 1] - self.layer[:, 0])).astype(np.float64)

    @property
    def base(self) -> float:
        return float(self.bias[1] - self.bias[0])


def train(sample: list[tuple[bytes, bytes, int]], epochs: int = EPOCHS, rate: float = RATE) -> Model:
    """Learn from (rows, counts, label) triples; the order of steps is fixed by a seed."""
    rng = np.random.default_rng(17)
    table = rng.uniform(-1 / DIM, 1 / DIM, (1 << BUCKET_BITS, DIM))
    layer, bias = np.zeros((DIM, 2)), np.zeros(2)
    labels = np.array([y for *_, y in sample], np.int64)
    share = (labels.mean() + 1e-9) / (1 + 2e-9) if len(labels) else 0.5
    if len(labels) == 0 or labels.min() == labels.max():
        bias[1] = np.log(max(share, 1e-9) / max(1 - share, 1e-9))
        return Model(table * 0, layer, bias)
    inputs = [(np.frombuffer(r, "<u4"), np.frombuffer(c, "<u4").astype(np.float64)) for r, c, _ in sample]
    steps, done = epochs * len(sample), 0
    for _ in range(epochs):
        for k in rng.permutation(len(sample)):
            rows, weight = inputs[k]
            pace = rate * (1 - done / steps)
            done += 1
            if not len(rows):
                continue
            weight = weight / weight.sum()
            mean = weight @ table[rows]
            odds = mean @ layer + bias
            chance = np.exp(odds - odds.max())
            error = chance / chance.sum()
            error[labels[k]] -= 1
            back = layer @ error
            layer -= pace * np.outer(mean, error)
            bias -= pace * 0.1 * error
            # A row's share of the mean is small: its step is scaled to the document's largest.
            table[rows] -= pace * np.outer(weight / weight.max(), back)
    return Model(table, layer, bias)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` labelled documents outside the held-out fold.

    Of the rows that share an id the text with the smallest hash counts.
    """
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = known.filter(fold(3) != 1).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counts(t) for t in rows_of(batch, "text")]
            arrays = [pa.array([f[k].tobytes() for f in found], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*arrays, batch.column("quality"), batch.column("doc_id")], ["rows", "counts", "quality", "doc_id"])

    # The sample's ids are at most ``sample`` rows: a proven bound.
    chosen = docs.select("doc_id", whole_text()).join(F.broadcast(known.select("doc_id", F.col("quality").cast("int"))), "doc_id")
    # One row for each id, so at most ``sample`` rows come to the driver, however often an id occurs.
    chosen = chosen.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = chosen.mapInArrow(count, "rows binary, counts binary, quality int, doc_id long").collect()
    rows.sort(key=lambda r: (r.doc_id, bytes(r.rows), bytes(r.counts)))
    return train([(bytes(r.rows), bytes(r.counts), int(r.quality > 0)) for r in rows])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row, from the whole text."""
    text_batches(docs.sparkSession)
    gain, base = model.gain, model.base

    def chance(text: str) -> float:
        total, n = 0.0, 0
        for found in features(text):
            total, n = total + float(gain[found].sum()), n + len(found)
        return float(1 / (1 + np.exp(-np.clip(base + (total / n if n else 0.0), -500, 500))))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([chance(t) for t in rows_of(batch, "text")], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), found], ["doc_id", "held_out", "score"])

    key = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", (fold(3) == 1).alias("held_out"), whole_text()).mapInArrow(scores, f"doc_id {key}, held_out boolean, score double")
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
