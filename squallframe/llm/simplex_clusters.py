"""Exact integer k-means whose comparisons are filtered by n-simplex projection.

A few pivots span a simplex. From the distances of a vector to the pivots, and from nothing else, follow the coordinates of an
apex over that simplex: its place in the simplex's own plane and its altitude above it. For two vectors

    |apex - apex'| <= distance <= |apex - apex' mirrored in the plane|

as they may stand on the same or on opposite sides. Apexes are worked out once and stored with the vectors; in each round the
centroids get theirs, centroids whose lower bound lies above the least upper bound are dropped, and the exact integer distance is
taken to those left.

Rows never move: a task reads its part, holds it against the k centroids, and passes on at most k sums for each Arrow batch. The
driver holds k centroids, their sums and the pivots, none of which grow with the rows.

Defined results: only vectors of ``width`` components, none null or non-finite, take part. Components are limited to
+-2**27, so that distances fit 64 bits. Rows that repeat an id are clustered each for itself; rows of null id take part, but start a
centroid only if there are too few others. With fewer than k vectors there are as many centroids; an
empty table gives no rows. A sum of distances beyond 64 bits is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

#: Largest size of a component; pivots at most; least altitude of a pivot over those before it, against the largest distance.
BOUND, PIVOTS, FLAT = 2**27, 8, 0.05
#: Rounding errors that bounds are widened by, as a share of the squared distances they come from.
SLACK = 1e-6


def integer_vectors(df: DataFrame, width: int, scale: float, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id`` and ``v``, floor(scale * x) of each component, of the vectors that take part."""
    x = F.col("x")
    bad = F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    limited = lambda e: F.greatest(F.least(F.floor(e * scale), F.lit(BOUND)), F.lit(-BOUND)).cast("int")
    return (df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("x"))
            .filter(F.size(x) == width).filter(~bad).select("vec_id", F.transform("x", limited).alias("v")))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column of equal lengths as rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def squared_distances(rows: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Exact, in 64 bits."""
    apart = rows.astype(np.int64) - one
    return np.einsum("ij,ij->i", apart, apart)


@dataclass
class Simplex:
    """Pivots, and the coordinates of all but the first, seen from it, as a lower triangle."""

    pivots: np.ndarray
    base: np.ndarray

    @classmethod
    def spanned_by(cls, rows: np.ndarray, most: int = PIVOTS) -> Simplex:
        """The first row, and then each time the row that stands highest over the pivots chosen, as long as one stands high."""
        chosen, base = [0], np.zeros((0, 0))
        large = max((float(squared_distances(rows, r).max()) for r in rows), default=0.0)
        while len(chosen) < min(most, len(rows)):
            own = cls(rows[chosen], base)
            apexes = own.apexes(rows)
            best = int(np.argmax(apexes[:, -1]))
            if apexes[best, -1] ** 2 <= FLAT ** 2 * large or best in chosen:
                break
            grown = np.zeros((len(base) + 1, len(base) + 1))
            grown[:-1, :-1], grown[-1] = base, apexes[best]
            chosen, base = [*chosen, best], grown
        return cls(rows[chosen], base)

    def apexes(self, rows: np.ndarray) -> np.ndarray:
        """Coordinates from the distances to the pivots, the altitude last."""
        squares = np.stack([squared_distances(rows, p) for p in self.pivots], axis=1).astype(np.float64)
        out, left = np.zeros(squares.shape), squares[:, 0].copy()
        for i, corner in enumerate(self.base):
            inner = (squares[:, 0] + corner @ corner - squares[:, i + 1]) / 2
            out[:, i] = (inner - out[:, :i] @ corner[:i]) / corner[i]
            left -= out[:, i] ** 2
        out[:, -1] = np.sqrt(np.maximum(left, 0))
        return out


def bounds(apexes: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared lower and upper bounds of the distance of every row to every centre, widened by rounding errors."""
    size = (apexes ** 2).sum(axis=1)[:, None] + (centres ** 2).sum(axis=1)
    lower = np.maximum(size - 2 * apexes @ centres.T, 0)
    return lower - SLACK * size - SLACK, lower + 4 * apexes[:, -1:] * centres[:, -1] + SLACK * size + SLACK


def nearest(rows: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each row, its squared distance (ties: the smaller number), and how many distances were taken."""
    lower, upper = bounds(apexes, centres)
    open_ = lower <= upper.min(axis=1)[:, None]
    cluster, best = np.zeros(len(rows), dtype=np.int64), np.full(len(rows), np.iinfo(np.int64).max)
    for c, centroid in enumerate(centroids):
        at = np.flatnonzero(open_[:, c])
        found = squared_distances(rows[at], centroid)
        nearer = found < best[at]
        cluster[at[nearer]], best[at[nearer]] = c, found[nearer]
    return cluster, best, int(open_.sum())


def projected(vectors: DataFrame, simplex: Simplex) -> DataFrame:
    """``vec_id``, ``v`` and ``apex``."""
    width = simplex.pivots.shape[1]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apexes = simplex.apexes(matrix(batch.column("v"), width))
            ends = pa.array(np.arange(len(apexes) + 1, dtype=np.int32) * apexes.shape[1])
            yield pa.record_batch([batch.column("vec_id"), batch.column("v"), pa.ListArray.from_arrays(ends, pa.array(apexes.ravel()))],
                                  names=["vec_id", "v", "apex"])

    return vectors.select("vec_id", "v").mapInArrow(apply, "vec_id long, v array<int>, apex array<double>")


def cluster_sums(points: DataFrame, simplex: Simplex, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Rows and component sums of each cluster that has any: at most one row for each centroid reaches the driver."""
    centres, width = simplex.apexes(centroids), centroids.shape[1]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix(batch.column("v"), width)
            cluster, _, _ = nearest(rows, matrix(batch.column("apex"), centres.shape[1]), centroids, centres)
            met = np.unique(cluster)
            sums = [rows[cluster == c].sum(axis=0, dtype=np.int64).tolist() for c in met]
            yield pa.record_batch([pa.array(met), pa.array([int((cluster == c).sum()) for c in met], pa.int64()), pa.array(sums, pa.list_(pa.int64()))],
                                  names=["cluster", "n", "sums"])

    parts = points.select("v", "apex").mapInArrow(apply, "cluster long, n long, sums array<long>")
    total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.element_at("sums", i + 1)).alias(f"s{i}") for i in range(width)])
    return {r[0]: (r[1], list(r[2:])) for r in total.collect()}


def assigned(points: DataFrame, simplex: Simplex, centroids: np.ndarray) -> DataFrame:
    """``vec_id``, ``cluster`` and exact squared ``distance``."""
    centres, width = simplex.apexes(centroids), centroids.shape[1]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance, _ = nearest(matrix(batch.column("v"), width), matrix(batch.column("apex"), centres.shape[1]), centroids, centres)
            yield pa.record_batch([batch.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return points.mapInArrow(apply, "vec_id long, cluster int, distance long")


def clusters(vectors: DataFrame, k: int, rounds: int, order: Column) -> DataFrame:
    """``vec_id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia`` and ``centroid_sha256`` of the integer vectors ``v``.

    Centroids start as the ``k`` rows that come first by ``order`` (ties by components).
    """
    first = vectors.select(order.alias("__order"), "v").orderBy(F.col("__order").asc_nulls_last(), "v").limit(k).collect()
    spark = vectors.sparkSession
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r["v"] for r in first], dtype=np.int64)
    simplex = Simplex.spanned_by(centroids)
    points = stored(projected(vectors, simplex))
    for _ in range(rounds):
        for c, (n, sums) in cluster_sums(points, simplex, centroids).items():
            centroids[c] = [s // n for s in sums]
    told = stored(assigned(points, simplex, centroids))
    found = {r[0]: r[1] for r in told.groupBy("cluster").agg(F.try_sum("distance")).collect()}
    whole = sum(found.values()) if None not in found.values() else None
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame([(c, s, whole if whole is not None and whole < 2**63 else None, digests[c]) for c, s in found.items()],
                                  "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return told.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
