"""Clusters against brute force, bounds against distances."""

import hashlib
import math
import random

import numpy as np
import pytest
from compare import compare, connect

from squallframe.llm.simplex_clusters import BOUND, Simplex, bounds, clusters, integer_vectors, nearest, squared_distances
from squallframe.llm.simplex_clusters_query import SQL, clustered, query
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("seed", range(12))
def test_bounds_hold_and_filter_nothing_wrongly(seed):
    rng = np.random.default_rng(seed)
    middle = rng.integers(-200, 200, (8, 24))
    rows = middle[rng.integers(0, 8, 300)] + rng.integers(-20, 20, (300, 24))
    rows[:20], rows[20:24] = rows[0], 0
    centroids = np.concatenate([middle, middle[:2], rows[:2]])
    simplex = Simplex.spanned_by(centroids)
    apexes, centres = simplex.apexes(rows), simplex.apexes(centroids)
    lower, upper = bounds(apexes, centres)
    exact = np.stack([squared_distances(rows, c) for c in centroids], axis=1)
    assert (lower <= exact).all() and (exact <= upper).all()
    cluster, distance, taken = nearest(rows, apexes, centroids, centres)
    assert cluster.tolist() == exact.argmin(axis=1).tolist() and distance.tolist() == exact.min(axis=1).tolist()
    assert taken < exact.size / 2  # well-parted centroids are told apart by their bounds


def test_flat_and_huge_pivots():
    line = np.arange(5)[:, None] * np.ones(3, dtype=int)
    assert len(Simplex.spanned_by(line).pivots) == 2
    assert len(Simplex.spanned_by(np.zeros((4, 3), dtype=int)).pivots) == 1
    far = np.array([[BOUND, -BOUND] * 32, [-BOUND, BOUND] * 32, [BOUND] * 64])
    simplex = Simplex.spanned_by(far)
    assert nearest(far, simplex.apexes(far), far, simplex.apexes(far))[0].tolist() == [0, 1, 2]
    assert squared_distances(far, far[0]).tolist() == [0, 2**62, 2**61]


def brute(vectors, k, rounds):
    """Rows (id, components) in plain integers."""
    name = lambda i: (i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest())
    centroids = [v for _, v in sorted(vectors, key=lambda r: (name(r[0]), r[1]))[:k]]
    tell = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids))
    for _ in range(rounds):
        own = [tell(v)[1] for _, v in vectors]
        for c in set(own):
            held = [v for (_, v), o in zip(vectors, own) if o == c]
            centroids[c] = [sum(x) // len(held) for x in zip(*held)]
    told = [(i, *tell(v)) for i, v in vectors]
    inertia = {c: sum(d for _, d, o in told if o == c) for _, _, c in told}
    return [(i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, d, c in told]


def test_odd_vectors_ties_and_hot_vectors(spark):
    rng = random.Random(4)
    made = [(i, [rng.choice([-1.5, -0.01, 0.0, 0.02, 2.25]) for _ in range(64)]) for i in range(120)]
    made += [(i, [0.25] * 64) for i in range(200, 300)] + [(7, made[8][1]), (7, made[7][1]), (None, made[3][1])]
    odd = [(500, None), (501, [0.1] * 63), (502, [None] + [0.1] * 63), (503, [math.nan] * 64), (504, [math.inf] * 64), (505, [])]
    frame = spark.createDataFrame([(i, v, "x", 3) for i, v in made + odd], "vec_id long, embedding array<float>, v string, cluster int").repartition(7)
    f32 = lambda v: [math.floor(float(np.float32(x)) * 64) for x in v]
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))
    assert order(tuple(r) for r in clustered(frame).collect()) == order(brute([(i, f32(v)) for i, v in made], 16, 3))
    few = frame.filter("vec_id in (1, 2)")
    assert order(tuple(r) for r in clustered(few).collect()) == order(brute([(i, f32(v)) for i, v in made[1:3]], 16, 3))
    assert clustered(frame.limit(0)).count() == 0 and clustered(frame.filter("vec_id >= 500")).count() == 0


def test_huge_components_are_limited(spark):
    frame = spark.createDataFrame([(1, [3e38] * 2), (2, [-3e38] * 2), (3, [0.5, 0.5])], "vec_id long, embedding array<float>")
    rows = integer_vectors(frame, 2, 64.0)
    assert [r.v for r in rows.orderBy("vec_id").collect()] == [[BOUND] * 2, [-BOUND] * 2, [32, 32]]
    assert sorted((r.vec_id, r.cluster, r.distance) for r in clusters(rows, 2, 0, F.col("vec_id").cast("string")).collect())[:2] == [(1, 0, 0), (2, 1, 0)]


def test_query_matches_sql(spark):
    assert compare(query(spark, FOLDER), connect(FOLDER), SQL) is None
