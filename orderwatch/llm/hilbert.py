"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is quantised to ``bits`` bits: language and source by
their hash, size by its logarithm. The cells are numbered along a
Hilbert curve, the rows are put in the order of (cell, key), and the order is cut
into ``n_shards`` runs whose row counts differ by one at most (law ``rows``). Near
rows of the curve are near in every dimension, so a file covers a small box and
filters on any dimension skip files.

Everything is a column expression. Ranks need no global sort: rows are counted by
(cell, slice of the key's hash), running totals are taken over these counts, and
rows are numbered inside their slice only. Slices keep a cell that holds a third of
all rows spread out.

Defined results: a NULL or empty text has size 1 and crc 0; NULL language or source is
a value of its own; repeated rows are all kept, equal ones in an arbitrary but gapless
order; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import let

BITS = 3
SLICES = 1024


def hilbert_index(axes: list[Column], bits: int) -> Column:
    """Index along the Hilbert curve of a point with coordinates below 2**bits.

    The axes are turned into their transposed form (inversions and exchanges from
    the highest bit down, then a Gray code) and the bits are interleaved.
    """
    n = len(axes)
    state = F.array(*[a.cast("int") for a in axes])
    for bit in range(bits - 1, 0, -1):
        q, p = 1 << bit, (1 << bit) - 1
        for i in range(n):
            state = let(state, _turn(i, q, p, n))
    for i in range(1, n):
        state = let(state, _gray(i, n))
    return let(state, lambda x: _flipped(x, n, bits))


def _flipped(x: Column, n: int, bits: int) -> Column:
    flip = F.lit(0)
    for bit in range(bits - 1, 0, -1):
        flip = flip.bitwiseXOR(F.when(x[n - 1].bitwiseAND(F.lit(1 << bit)) != 0, F.lit((1 << bit) - 1)).otherwise(F.lit(0)))
    return let(flip, lambda t: _interleave([x[k].bitwiseXOR(t) for k in range(n)], bits))


def _turn(i: int, q: int, p: int, n: int) -> Callable[[Column], Column]:
    """Where bit ``q`` of axis ``i`` is set invert the lower bits of axis 0, else exchange them with axis ``i``."""

    def body(x: Column) -> Column:
        swap = x[0].bitwiseXOR(x[i]).bitwiseAND(F.lit(p))
        invert = [x[k].bitwiseXOR(F.lit(p)) if k == 0 else x[k] for k in range(n)]
        exchange = [x[k].bitwiseXOR(swap) if k in (0, i) and i else x[k] for k in range(n)]
        return F.when(x[i].bitwiseAND(F.lit(q)) != 0, F.array(*invert)).otherwise(F.array(*exchange))

    return body


def _gray(i: int, n: int) -> Callable[[Column], Column]:
    return lambda x: F.array(*[x[k].bitwiseXOR(x[i - 1]) if k == i else x[k] for k in range(n)])


def _interleave(x: list[Column], bits: int) -> Column:
    total = F.lit(0)
    for bit in range(bits - 1, -1, -1):
        for axis in x:
            total = total * 2 + F.shiftright(axis, bit).bitwiseAND(F.lit(1))
    return total


def _hashed(name: str, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(F.col(name).cast("string"), F.lit("\u0000"))), F.lit(1 << bits)).cast("int")


def _log_bin(size: Column, bits: int) -> Column:
    """Powers of two; sizes past the last bin share it."""
    return F.least(F.greatest(F.floor(F.log2(size.cast("double"))) - 5, F.lit(0)), F.lit((1 << bits) - 1)).cast("int")


def shard(docs: DataFrame, n_shards: int = 8, bits: int = BITS, slices: int = SLICES) -> DataFrame:
    """(doc_id, size, text_crc32, lang, source, cell, shard, slot) for each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        "lang",
        "source",
    )
    mark = F.xxhash64("text_crc32", "size", "doc_id")
    rows = rows.withColumn("cell", hilbert_index([_hashed("lang", bits), _hashed("source", bits), _log_bin(F.col("size"), bits)], bits))
    rows = rows.withColumn("mark", mark).withColumn("slice", F.pmod(F.shiftright("mark", 40), F.lit(slices)).cast("int"))

    counts = rows.groupBy("cell", "slice").agg(F.count("*").alias("n"))
    inside = Window.partitionBy("cell").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    # At most 2**(axes * bits) cells: one small window.
    cells = counts.groupBy("cell").agg(F.sum("n").alias("n"))
    over = Window.partitionBy(F.lit(0)).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("cell", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("cell_start"), F.sum("n").over(Window.partitionBy(F.lit(0))).alias("total"))
    starts = counts.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(cells), "cell")
    starts = starts.select("cell", "slice", (F.col("cell_start") + F.col("before")).alias("start"), "total")

    # At most cells * slices rows (524,288 at the defaults): a proven bound.
    local = Window.partitionBy("cell", "slice").orderBy("mark", "doc_id", "size", "text_crc32")
    ranked = rows.withColumn("place", F.row_number().over(local) - 1).join(F.broadcast(starts), ["cell", "slice"])
    rank = F.col("start") + F.col("place")
    # rank belongs to shard s if ceil(s * total / n) <= rank; integers only.
    ranked = ranked.withColumn("rank", rank).withColumn("shard", F.expr(f"cast((rank * {n_shards}L) div total as int)"))
    first = F.expr(f"(shard * total + {n_shards - 1}L) div {n_shards}L")
    return ranked.select("doc_id", "size", "text_crc32", "lang", "source", "cell", "shard", (F.col("rank") - first).cast("long").alias("slot"))
