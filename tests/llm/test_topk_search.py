"""Exact search against brute force."""

import math

import numpy as np

from squallframe.llm import topk_search
from squallframe.llm.topk_search import best_in_cell, integer_vectors, segment_statistics, top_k


def brute(ids, vectors, query_ids, k):
    out = []
    for q in query_ids:
        own = vectors[ids.index(q)]
        scored = sorted((-sum(a * b for a, b in zip(own, v)), i) for i, v in zip(ids, vectors) if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return out


def test_matches_brute_force_over_many_cells(spark, monkeypatch):
    for name, value in (("QUERY_GROUP", 16), ("SLOT", 60), ("BLOCK", 32)):
        monkeypatch.setattr(topk_search, name, value)
    rng = np.random.default_rng(1)
    data = np.repeat(rng.normal(size=(60, 20)), 5, axis=0) + (rng.random((300, 1)) < 0.5) * rng.normal(size=(300, 20)) * 0.1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<float>")
    ints = integer_vectors(df)
    rows = {r.vec_id: r.v for r in ints.collect()}
    got = sorted(tuple(r) for r in top_k(ints, ints.filter("vec_id % 7 = 0"), 5).collect())
    assert got == brute(list(rows), list(rows.values()), [i for i in rows if i % 7 == 0], 5)


def test_bounds_hold():
    rng = np.random.default_rng(2)
    q, c = rng.integers(-300, 300, (30, 13)), rng.integers(-300, 300, (40, 13))
    for s in (1, 4, 16):
        (qm, qd), (cm, cd) = segment_statistics(q, s), segment_statistics(c, s)
        bound = qm @ cm.T + qd @ cd.T
        assert (bound + 1e-6 >= q @ c.T).all()


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (50, [1.0]), (100, []), (1, None), (2, [None, 1.0]), (3, [math.nan, 1.0]), (4, [math.inf]),
            (5, [0.5, -0.001, 3.0]), (None, [1.0, 1.0]), (6, [1.0, 2.0])]
    ints = integer_vectors(spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int"))
    got = sorted(tuple(r) for r in top_k(ints, ints.filter("vec_id % 50 = 0")).collect())
    assert [r for r in got if r[0] == 0] == [(0, 1, 6, 5 * 65536), (0, 2, 50, 65536), (0, 3, 5, 128 * 256 - 512), (0, 4, 100, 0)]
    assert [r[2] for r in got if r[0] == 100] == [0, 5, 6, 50]
    none = integer_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert top_k(none, none).count() == 0


def test_cell_with_fewer_than_k():
    out = best_in_cell(np.array([1]), np.array([[1, 2]]), np.array([1, 2]), np.array([[1, 2], [3, 4]]), 5)
    assert out.to_numpy().tolist() == [[1, 11, 2]]


def test_ties_of_negative_scores(monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK", 1)
    out = best_in_cell(np.array([1]), np.array([[1000] * 4]), np.array([9, 2]), np.array([[-1000] * 4, [-1000] * 4]), 1)
    assert out.to_numpy().tolist() == [[1, -4_000_000, 2]]
