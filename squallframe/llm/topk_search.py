"""Exact top-k inner products with multi-resolution segment statistics.

A vector is cut into segments; each keeps its mean and its deviation. For two vectors,

    q . c <= sum over segments of L * mean_q * mean_c + |q - mean_q| * |c - mean_c|

which in terms of distances is the lower bound |q|^2 + |c|^2 - 2 * (that sum). Finer segments give tighter
bounds. Candidates are held against the k-th best score so far from coarse to fine, and exact
integer products are computed for the survivors only.

Queries and candidates meet in blocks on a grid (query group, candidate slot): each cell is one task's work
of bounded size, keeps the k best of its candidates for each of its queries, and the cells'
lists are merged by query. Nothing is broadcast, and no pair of rows is ever a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries in a group, candidates in a slot, and candidates bounded at a time.
QUERY_GROUP, SLOT, BLOCK = 1024, 16384, 1024
#: Segment counts from coarse to fine.
LEVELS = (1, 4, 16)


def integer_vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = 256.0) -> DataFrame:
    """``vec_id`` and ``v``: floor(scale * x) of each component.

    Null vectors and vectors with a null or non-finite component take no part; an empty vector is
    the zero vector, and a shorter one counts as zero where it has no component.
    """
    x = F.col("x")
    bad = F.exists("x", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return (df.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("x"))
            .filter(x.isNotNull()).filter(~bad)
            .select("vec_id", F.transform("x", lambda e: F.floor(e * scale).cast("long")).alias("v")))


def packed(df: DataFrame, key: str, name: str) -> DataFrame:
    """Rows of (key, vec_id, v) as one row for each key and Arrow batch: ids, and a matrix of longs."""
    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for group, rows in batch.groupby(key, sort=False):
                width = max(map(len, rows["v"]))
                matrix = np.zeros((len(rows), width), dtype=np.int64)
                for i, v in enumerate(rows["v"]):
                    matrix[i, :len(v)] = v
                out.append((group, rows["vec_id"].to_numpy(np.int64).tobytes(), width, matrix.tobytes()))
            yield pd.DataFrame(out, columns=[key, f"{name}_ids", f"{name}_width", f"{name}_data"])

    return df.mapInPandas(apply, f"{key} long, {name}_ids binary, {name}_width int, {name}_data binary")


def unpack(rows: pd.DataFrame, name: str) -> tuple[np.ndarray, np.ndarray]:
    ids = [np.frombuffer(b, np.int64) for b in rows[f"{name}_ids"]]
    width = int(rows[f"{name}_width"].max())
    parts = []
    for own, w, data in zip(ids, rows[f"{name}_width"], rows[f"{name}_data"]):
        part = np.zeros((len(own), width), dtype=np.int64)
        part[:, :w] = np.frombuffer(data, np.int64).reshape(len(own), w)
        parts.append(part)
    return np.concatenate(ids), np.concatenate(parts)


def segment_statistics(vectors: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the segments, both times the root of the segment's length."""
    width = vectors.shape[1]
    length = -(-max(width, 1) // segments)
    padded = np.zeros((len(vectors), segments, length))
    padded.reshape(len(vectors), -1)[:, :width] = vectors
    mean = padded.mean(axis=2)
    return mean * np.sqrt(length), np.sqrt(((padded - mean[:, :, None]) ** 2).sum(axis=2))


def exact_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Row-wise integer products."""
    return np.einsum("ij,ij->i", q, c)


def best_in_cell(q_ids, queries, c_ids, candidates, k: int) -> pd.DataFrame:
    """The k best candidates of each query by (score, smaller id), from coarse bounds to exact scores."""
    width = max(queries.shape[1], candidates.shape[1])
    queries = np.pad(queries, ((0, 0), (0, width - queries.shape[1])))
    candidates = np.pad(candidates, ((0, 0), (0, width - candidates.shape[1])))
    levels = [(segment_statistics(queries, s), segment_statistics(candidates, s)) for s in LEVELS if s <= max(width, 1)]
    least = np.full(len(q_ids), -np.inf)  # the k-th best exact score so far
    held: list[list[tuple[int, int]]] = [[] for _ in q_ids]
    for at in range(0, len(c_ids), BLOCK):
        ids, block = c_ids[at:at + BLOCK], candidates[at:at + BLOCK]
        q_rows, c_rows = None, None
        for (qm, qd), (cm, cd) in levels:
            if q_rows is None:
                bound = qm @ cm[at:at + BLOCK].T + qd @ cd[at:at + BLOCK].T
                alive = bound + 1e-9 * np.abs(bound) + 1e-6 >= least[:, None]
                alive &= q_ids[:, None] != ids[None, :]
                q_rows, c_rows = np.nonzero(alive)
            else:
                bound = (np.einsum("ij,ij->i", qm[q_rows], cm[at + c_rows]) + np.einsum("ij,ij->i", qd[q_rows], cd[at + c_rows]))
                keep = bound + 1e-9 * np.abs(bound) + 1e-6 >= least[q_rows]
                q_rows, c_rows = q_rows[keep], c_rows[keep]
        scores = exact_scores(queries[q_rows], block[c_rows])
        keep = scores >= least[q_rows]
        q_rows, scores, own = q_rows[keep], scores[keep], ids[c_rows[keep]]
        order = np.lexsort((own, -scores, q_rows))
        q_rows, scores, own = q_rows[order], scores[order], own[order]
        starts = np.flatnonzero(np.r_[True, q_rows[1:] != q_rows[:-1]]) if len(q_rows) else np.array([], dtype=int)
        for a, b in zip(starts, np.r_[starts[1:], len(q_rows)]):
            q = q_rows[a]
            best = sorted([*held[q], *zip((-scores[a:min(a + k, b)]).tolist(), own[a:min(a + k, b)].tolist())])[:k]
            held[q] = best
            if len(best) == k:
                least[q] = -best[-1][0]
    rows = [(int(q), -s, c) for q, best in zip(q_ids, held) for s, c in best]
    return pd.DataFrame(rows, columns=["query_id", "score", "vec_id"]).astype({"query_id": "int64", "score": "int64", "vec_id": "int64"})


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best candidates, ties to the smaller id.

    Both frames have ``vec_id`` and ``v`` (array of longs). A query never meets rows of its own id. Rows that
    repeat a query id with different vectors are one query each and share its k best.
    Null ids take no part; empty tables give no rows.
    """
    n_queries, n_rows = queries.count(), vectors.count()
    groups, slots = max(1, -(-n_queries // QUERY_GROUP)), max(1, -(-n_rows // SLOT))
    spread = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n))
    cell = lambda g, s: (g * F.lit(slots) + s).cast("long").alias("cell")
    grid = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = (packed(queries.filter("vec_id is not null").withColumn("g", spread(groups)), "g", "q")
            .withColumn("s", grid(slots)).select(cell(F.col("g"), F.col("s")), "q_ids", "q_width", "q_data"))
    right = (packed(vectors.filter("vec_id is not null").withColumn("s", spread(slots)), "s", "c")
             .withColumn("g", grid(groups)).select(cell(F.col("g"), F.col("s")), "c_ids", "c_width", "c_data"))

    def apply(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if q.empty or c.empty:
            return pd.DataFrame({"query_id": [], "score": [], "vec_id": []}).astype("int64")
        return best_in_cell(*unpack(q, "q"), *unpack(c, "c"), k)

    cells = left.groupBy("cell").cogroup(right.groupBy("cell")).applyInPandas(apply, "query_id long, score long, vec_id long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (cells.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
