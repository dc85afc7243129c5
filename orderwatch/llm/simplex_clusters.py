"""Exact k-means over integer vectors; n-simplex bounds spare most centroid comparisons.

A few pivots span a simplex. From the distances of a vector to the pivots follows the apex
that the vector would have over that simplex: its coordinates in the pivots' space and, as the
last one, its height above. For two apexes the Euclidean distance is a lower bound of the
vectors' true distance, and the same with the sum of both heights an upper bound. Apexes of
all vectors are worked out once and kept with them; in each round a centroid whose lower bound
exceeds the best upper bound is out, and the others are compared as integers, exactly.
Pivots change the work only, never the result.

Tasks add up their vectors by cluster; sums are cut into limbs of LIMB_BITS bits, so any number of
them is added exactly. Only centroids, ``k`` rows, and their sums come to the driver.

Defined results: rows with another number of components, a NULL or a non-finite one, and NULL
vectors are left out; a NULL id counts as empty text where vectors are chosen to start; rows that
repeat an id or a vector are rows like any other, and where start hashes tie the smaller vector
comes first; fewer vectors than ``k`` give fewer centroids, none give no rows; further
columns are ignored. Components beyond LARGE are compared without bounds in
integers of any size; a distance or sum that no long can hold is NULL.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored, text_batches

DIMENSIONS, CLUSTERS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, "3"
PIVOTS, PIVOT_CHOICE = 12, 256
# Below this, squared distances of up to 64 components stay inside 64 bits.
LARGE = 1 << 27
LIMB_BITS = 30
MAX_LONG = 2**63 - 1
# Bounds are widened by this share of the distances they come from, far more than doubles lose.
SLACK = 1e-5
# A pivot is used only if it stands out of the others' space by this share of their distances.
MIN_HEIGHT = 0.1


def usable(vector: Column, dimensions: int = DIMENSIONS) -> Column:
    """Whether a vector has exactly so many components, all finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dimensions) & finite, F.lit(False))


def integers(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of each component: 64-bit integers, or Python's where these would not do."""
    with np.errstate(over="ignore"):
        scaled = np.floor(vectors * scale)
    # A power of two scales a double without rounding.
    if scale & (scale - 1) == 0 and (not scaled.size or np.abs(scaled).max() <= LARGE):
        return scaled.astype(np.int64)
    exact = np.array([floor(Fraction(float(x)) * scale) for x in vectors.ravel()] or [0], object)[: vectors.size].reshape(vectors.shape)
    return exact.astype(np.int64) if vectors.size and np.abs(exact).max() <= LARGE else exact


@dataclass(frozen=True)
class Simplex:
    """Pivots, and the inverse of their simplex's lower-triangular coordinates."""

    pivots: np.ndarray
    inverse: np.ndarray

    def apexes(self, vectors: np.ndarray) -> np.ndarray:
        """A row for each vector: coordinates over the simplex, height, distance to the first pivot."""
        if vectors.dtype == object or not len(self.pivots):
            return np.zeros((len(vectors), len(self.inverse) + 2))
        squares = np.stack([((vectors - p) ** 2).sum(1) for p in self.pivots], 1).astype(float)
        base = ((self.pivots[1:] - self.pivots[0]) ** 2).sum(1).astype(float)
        # Inner products with the edges from the first pivot follow from the squared distances alone.
        inner = (squares[:, :1] - squares[:, 1:] + base) / 2
        flat = inner @ self.inverse.T
        height = np.sqrt(np.maximum(squares[:, 0] - (flat**2).sum(1), 0))
        return np.column_stack([flat, height, np.sqrt(squares[:, 0])])


def simplex(choice: np.ndarray, pivots: int = PIVOTS) -> Simplex:
    """Pivots out of ``choice``: each next one stands farthest out of the space of those before."""
    if not len(choice) or choice.dtype == object:
        return Simplex(np.zeros((0, DIMENSIONS), np.int64), np.zeros((0, 0)))
    chosen, edges = [0], choice.astype(float) - choice[0]
    rest, largest = edges.copy(), np.sqrt((edges**2).sum(1).max())
    while len(chosen) < pivots:
        heights = np.sqrt((rest**2).sum(1))
        best = int(heights.argmax())
        if heights[best] <= MIN_HEIGHT * largest or largest == 0:
            break
        axis = rest[best] / heights[best]
        rest = rest - np.outer(rest @ axis, axis)
        chosen.append(best)
    lower = np.linalg.cholesky(edges[chosen[1:]] @ edges[chosen[1:]].T) if len(chosen) > 1 else np.zeros((0, 0))
    return Simplex(choice[chosen], np.linalg.inv(lower) if len(chosen) > 1 else lower)


def nearest(vectors: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, tops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number, squared distance and compared centroids of each vector; ties go to the smaller number."""
    n, k = len(vectors), len(centroids)
    possible = np.ones((n, k), bool)
    if vectors.dtype != object and centroids.dtype != object and apexes.shape[1] == tops.shape[1] and n:
        flat = ((apexes[:, None, :-2] - tops[None, :, :-2]) ** 2).sum(2)
        lower = np.sqrt(flat + (apexes[:, None, -2] - tops[None, :, -2]) ** 2)
        upper = np.sqrt(flat + (apexes[:, None, -2] + tops[None, :, -2]) ** 2)
        slack = SLACK * (apexes[:, -1:] + tops[None, :, -1])
        possible = lower - slack <= (upper + slack).min(1, keepdims=True)
    wide = object if vectors.dtype == object or centroids.dtype == object else np.int64
    best, where = np.full(n, -1, wide), np.zeros(n, np.int32)
    for c in range(k):
        rows = np.flatnonzero(possible[:, c])
        apart = vectors[rows].astype(wide) - centroids[c]
        distance = (apart * apart).sum(1)
        closer = (best[rows] < 0) | (distance < best[rows])
        best[rows[closer]], where[rows[closer]] = distance[closer], c
    return where, best, possible.sum(1)


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    sign, value, limb = (1 if value >= 0 else -1), abs(value), 0
    while value:
        yield limb, sign * (value & ((1 << LIMB_BITS) - 1))
        value, limb = value >> LIMB_BITS, limb + 1


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(float).reshape(-1, width)


def _prepared(vectors: DataFrame, base: Simplex, dimensions: int, scale: int) -> DataFrame:
    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apexes = base.apexes(integers(_matrix(batch.column("vector"), dimensions), scale))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(apexes.ravel()), apexes.shape[1]).cast(pa.list_(pa.float64()))
            yield batch.append_column("apex", lists)

    return stored(vectors.mapInArrow(prepare, f"{vectors._jdf.schema().toDDL()}, apex array<double>"), "vectors")


def _sums(rows: DataFrame, centroids: np.ndarray, base: Simplex, dimensions: int, scale: int) -> tuple[dict[int, int], np.ndarray]:
    """Rows of each cluster and the exact sums of their components."""
    tops = base.apexes(centroids)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dimensions), object)
        for batch in batches:
            x = integers(_matrix(batch.column("vector"), dimensions), scale)
            where, _, _ = nearest(x, _matrix(batch.column("apex"), tops.shape[1]), centroids, tops)
            for c in np.unique(where):
                counts[c] += (where == c).sum()
                totals[c] += x[where == c].sum(0).astype(object)
        found = [(c, -1, 0, int(counts[c])) for c in np.flatnonzero(counts)]
        found += [(c, p, limb, v) for c in np.flatnonzero(counts) for p in range(dimensions) for limb, v in _limbs(int(totals[c, p]))]
        columns = [pa.array([int(r[k]) for r in found], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "place", "limb", "value"])

    parts = rows.select("vector", "apex").mapInArrow(add, "cluster int, place int, limb int, value long")
    counts, totals = {}, np.zeros((len(centroids), dimensions), object)
    for r in parts.groupBy("cluster", "place", "limb").agg(F.sum("value").alias("value")).collect():  # k * dimensions * limbs rows at most
        if r.place < 0:
            counts[r.cluster] = r.value
        else:
            totals[r.cluster, r.place] += r.value << (LIMB_BITS * r.limb)
    return counts, totals


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: str = SEED, pivots: int = PIVOTS) -> DataFrame:
    """(vec_id, cluster, distance, compared, cluster_inertia, inertia, centroid_sha256) for each usable row of (vec_id, embedding).

    ``compared`` counts the centroids that the bounds left for the exact comparison.
    """
    spark = vectors.sparkSession
    text_batches(spark, 4096)
    kept = vectors.filter(usable(F.col("embedding"), dimensions)).select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.orderBy(rank, "vector").limit(max(k, PIVOT_CHOICE)).select("vector").collect()
    choice = integers(np.array([r.vector for r in first], float).reshape(-1, dimensions), scale)
    centroids, base = choice[:k], simplex(choice, pivots)
    rows = _prepared(kept, base, dimensions, scale)
    for _ in range(rounds if len(centroids) else 0):
        counts, totals = _sums(rows, centroids, base, dimensions, scale)
        moved = centroids.astype(object)
        for c, n in counts.items():
            moved[c] = [int(total) // n for total in totals[c]]
        centroids = moved.astype(np.int64) if np.abs(moved).max() <= LARGE else moved
    tops = base.apexes(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = integers(_matrix(batch.column("vector"), dimensions), scale)
            where, distance, compared = nearest(x, _matrix(batch.column("apex"), tops.shape[1]), centroids, tops)
            fits = [int(d) if d <= MAX_LONG else None for d in distance]
            columns = [batch.column("vec_id"), pa.array(where, pa.int32()), pa.array(fits, pa.int64()), pa.array(compared.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance", "compared"])

    kind = dict(kept.dtypes)["vec_id"]
    placed = stored(rows.mapInArrow(assign, f"vec_id {kind}, cluster int, distance long, compared int"), "clusters")
    # Decimals add exactly; a NULL distance makes the sum NULL.
    whole = F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast("decimal(38,0)"))).alias("total")
    sums = {r.cluster: r.total for r in placed.groupBy("cluster").agg(whole).collect()}  # k rows at most
    total = None if None in sums.values() else sum(sums.values())
    long = lambda v: int(v) if v is not None and v <= MAX_LONG else None
    about = [(c, long(sums[c]), long(total), hashlib.sha256(",".join(str(int(v)) for v in centroids[c]).encode()).hexdigest()) for c in sums]
    about = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "compared", "cluster_inertia", "inertia", "centroid_sha256")
