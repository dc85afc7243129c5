"""Language identification with a byte convolutional network.

A text is cut into windows of WINDOW bytes, all of them used. Bytes are embedded, filters
of several widths run over each window, each filter keeps its largest answer, and a
softmax layer gives the chance of each language; the document's chances are the mean
over its windows. The network is trained in numpy (Adam, gradients through the places of
the largest answers).

Learning uses a bounded sample: of each language the ``per_lang`` documents outside the
held-out fold that come first in the order of their id's hash, and ``per_doc`` windows
spread over each whole text. Applying it, embedding and filter weights are multiplied
out to one table per filter position, and windows of several texts share a batch.

Defined results: ``und`` with score 0 for a NULL or empty text, one without a letter, and
for all texts if nothing could be learned; the language that sorts first wins a tie;
repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import fold, rows_of, text_batches, whole_text

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
DIM = 8
PER_LANG = 500
PER_DOC = 4
# A bound on hashes lets about so many times the wanted documents of a language through.
SPARE = 4
EPOCHS = 4
BATCH = 96
UNKNOWN = "und"


@dataclass
class Net:
    langs: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    offsets: list[np.ndarray]
    layer: np.ndarray
    bias: np.ndarray

    def tables(self) -> list[list[np.ndarray]]:
        """For each width and position inside the filter: answer of each byte value."""
        return [[(self.embed @ f[k * DIM : (k + 1) * DIM]).astype(np.float32) for k in range(w)] for w, f in zip(WIDTHS, self.filters)]


def cut(data: bytes) -> np.ndarray:
    """All windows of a text; the last is filled up with zeros."""
    n = -(-len(data) // WINDOW)
    return np.frombuffer(data + bytes(n * WINDOW - len(data)), np.uint8).reshape(n, WINDOW)


def spread(windows: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` windows, evenly over the text."""
    return windows[np.unique(np.linspace(0, len(windows) - 1, min(n, len(windows))).astype(int))] if len(windows) else windows


def train(windows: np.ndarray, target: np.ndarray, langs: list[str], epochs: int = EPOCHS) -> Net:
    rng = np.random.default_rng(11)
    net = Net(
        langs,
        rng.normal(0, 0.5, (256, DIM)),
        [rng.normal(0, 1 / np.sqrt(w * DIM), (w * DIM, FILTERS)) for w in WIDTHS],
        [np.zeros(FILTERS) for _ in WIDTHS],
        np.zeros((FILTERS * len(WIDTHS), len(langs))),
        np.zeros(len(langs)),
    )
    weights = [net.embed, *net.filters, *net.offsets, net.layer, net.bias]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            step += 1
            for w, g, m, v in zip(weights, _gradients(net, windows[some], target[some]), first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def _gradients(net: Net, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    n, embedded, pooled, places = len(x), net.embed[x].astype(np.float32), [], []
    for w, f, b in zip(WIDTHS, net.filters, net.offsets):
        span = WINDOW - w + 1
        answer = sum(embedded[:, k : k + span] @ f[k * DIM : (k + 1) * DIM].astype(np.float32) for k in range(w))
        best = answer.argmax(1)
        places.append(best)
        pooled.append(np.take_along_axis(answer, best[:, None, :], 1)[:, 0] + b)
    raw = np.concatenate(pooled, 1)
    hidden = np.maximum(raw, 0)
    odds = hidden @ net.layer + net.bias
    chance = np.exp(odds - odds.max(1, keepdims=True))
    error = chance / chance.sum(1, keepdims=True)
    error[np.arange(n), y] -= 1
    error /= n
    back = (error @ net.layer.T) * (raw > 0)
    g_embed, g_filters, g_offsets, rows = np.zeros_like(net.embed), [], [], np.arange(n)[:, None]
    for i, (w, f) in enumerate(zip(WIDTHS, net.filters)):
        own, grad = back[:, i * FILTERS : (i + 1) * FILTERS], np.zeros_like(f)
        for k in range(w):
            codes = x[rows, places[i] + k]
            grad[k * DIM : (k + 1) * DIM] = np.einsum("nfd,nf->df", net.embed[codes], own)
            np.add.at(g_embed, codes.ravel(), (own[:, :, None] * f[k * DIM : (k + 1) * DIM].T[None]).reshape(-1, DIM))
        g_filters.append(grad)
        g_offsets.append(own.sum(0))
    return [g_embed, *g_filters, *g_offsets, hidden.T @ error, error.sum(0)]


def chances(net: Net, tables: list[list[np.ndarray]], x: np.ndarray) -> np.ndarray:
    pooled = []
    for w, table, b in zip(WIDTHS, tables, net.offsets):
        span = WINDOW - w + 1
        answer = table[0][x[:, :span]]
        for k in range(1, w):
            answer += table[k][x[:, k : k + span]]
        pooled.append(np.maximum(answer.max(1) + b, 0))
    odds = np.concatenate(pooled, 1) @ net.layer + net.bias
    odds = np.exp(odds - odds.max(1, keepdims=True))
    return odds / odds.sum(1, keepdims=True)


def fit(docs: DataFrame, per_lang: int = PER_LANG, per_doc: int = PER_DOC) -> Net | None:
    """Learn from at most ``per_lang`` documents of each language; None if no document has text and a language.

    Of the rows that share an id and a language the text with the smallest hash counts.
    """
    known = docs.filter("lang is not null and length(text) > 0").filter(fold(4) != 2)
    counts = known.groupBy("lang").count().collect()  # a row for each language, which is a class to learn
    names = sorted(r.lang for r in counts)
    if not names:
        return None
    # The wanted documents have the smallest hashes; a bound on these leaves few rows of each language to rank.
    shares = [(r.lang, int(-(2**63) + 2**64 * min(SPARE * per_lang / r["count"], 1)) - 1) for r in counts]
    bounds = F.broadcast(docs.sparkSession.createDataFrame([(n, min(b, 2**63 - 1)) for n, b in shares], "lang string, bound long"))
    few = known.select("doc_id", "lang").join(bounds, "lang").filter(F.xxhash64("doc_id") <= F.col("bound")).select("doc_id", "lang").distinct()
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = few.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_lang)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = [spread(cut(t.encode()), per_doc).tobytes() for t in rows_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(some, pa.binary())], ["doc_id", "lang", "windows"])

    # At most per_lang ids for each language: a proven bound, and one row for each comes to the driver.
    chosen = known.select("doc_id", "lang", "text").join(F.broadcast(ids.select("doc_id", "lang")), ["doc_id", "lang"])
    chosen = chosen.groupBy("doc_id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    key = docs.schema["doc_id"].dataType.simpleString()
    rows = chosen.mapInArrow(sample, f"doc_id {key}, lang string, windows binary").collect()
    rows = sorted((r for r in rows if r.lang in names), key=lambda r: (str(r.doc_id), r.lang, bytes(r.windows)))
    parts = [np.frombuffer(bytes(r.windows), np.uint8).reshape(-1, WINDOW) for r in rows]
    target = np.concatenate([np.full(len(p), names.index(r.lang)) for p, r in zip(parts, rows)])
    return train(np.concatenate(parts), target, names)


def predict(docs: DataFrame, net: Net | None, *, carry: bool = False) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row; with ``carry`` the row itself is the struct ``doc``."""
    text_batches(docs.sparkSession)
    judged = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    tables = net.tables() if net else None

    def of(texts: Iterator[tuple[str, bool]]) -> tuple[list[str], list[float]]:
        total: list[np.ndarray | None] = []
        held: list[tuple[int, np.ndarray]] = []

        def flush() -> None:
            found, at = chances(net, tables, np.concatenate([w for _, w in held])), 0
            for k, w in held:
                total[k] += found[at : at + len(w)].sum(0)
                at += len(w)
            held.clear()

        for k, (text, wanted) in enumerate(texts):
            total.append(np.zeros(len(net.langs)) if net and wanted else None)
            if net and wanted:
                windows = cut(text.encode())
                for at in range(0, len(windows), BATCH):
                    held.append((k, windows[at : at + BATCH]))
                    if sum(len(w) for _, w in held) >= BATCH:
                        flush()
        if held:
            flush()
        best = [(UNKNOWN, 0.0) if t is None else (net.langs[int(t.argmax())], float(t.max() / t.sum())) for t in total]
        return [b[0] for b in best], [b[1] for b in best]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 512) for k in range(0, batch.num_rows, 512)):
                texts = (v.as_py() for v in pc.struct_field(part.column("doc"), "text")) if carry else rows_of(part, "text")
                langs, scores = of(zip(texts, rows_of(part, "judged")))
                kept = [part.column(k) for k in range(part.num_columns) if part.schema.names[k] not in ("text", "judged")]
                names = [n for n in part.schema.names if n not in ("text", "judged")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(langs), pa.array(scores, pa.float64())], [*names, "lang_pred", "score"])

    first = F.struct("*").alias("doc") if carry else F.col("doc_id")
    text = [] if carry else [whole_text()]
    rows = docs.select(first, (fold(4) == 2).alias("held_out"), *text, judged.alias("judged"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(judge, f"{rows.columns[0]} {kind}, held_out boolean, lang_pred string, score double")
