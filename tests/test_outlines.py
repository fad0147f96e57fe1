"""The corner-parity index and the box hierarchy against brute force."""

import math
import uuid

import numpy as np
import pandas as pd
import pytest

from squallframe.operators import spatial
from squallframe.sources.sinks import write_by_key

EDGES = "unit_id long, x1 double, y1 double, x2 double, y2 double"


def ring(unit, pts):
    return [(unit, *map(float, a), *map(float, b)) for a, b in zip(pts, pts[1:] + pts[:1])]


def star(unit, rng, n, centre, low, high, snap=None):
    angles = np.sort(rng.uniform(0, 2 * math.pi, n))
    radius = rng.uniform(low, high, n)
    pts = np.stack([centre[0] + radius * np.cos(angles), centre[1] + radius * np.sin(angles)], axis=1)
    return ring(unit, (np.round(pts / snap) * snap if snap else pts).tolist())


def inside(edges, pts):
    out = set()
    e = np.array([r[1:] for r in edges])
    unit = np.array([r[0] for r in edges])
    for x, y in pts:
        with np.errstate(divide="ignore", invalid="ignore"):
            hit = ((e[:, 1] > y) != (e[:, 3] > y)) & (x < (e[:, 2] - e[:, 0]) * (y - e[:, 1]) / (e[:, 3] - e[:, 1]) + e[:, 0])
        out |= {(x, y, int(u)) for u in np.unique(unit[hit]) if hit[unit == u].sum() % 2}
    return out


@pytest.mark.parametrize("tile", [1.0, 0.7, 3.0])
def test_containment_by_corner_parity(spark, tile):
    rng = np.random.default_rng(11)
    edges = [e for u in range(4) for e in star(u, rng, 40, (u * 3.0, u - 1.0), 1.0, 5.0)]
    edges += [e for u in range(4, 8) for e in star(u, rng, 12, (u - 4.0, 1.0), 1.0, 6.0, 0.5)]  # corners and sides on tile borders
    edges += ring(8, [(0, 0), (9, 0), (9, 9), (0, 9)]) + ring(8, [(3, 3), (6, 3), (6, 6), (3, 6)])  # with a hole
    pts = np.concatenate([rng.uniform(-7, 14, (700, 2)), np.round(rng.uniform(-7, 14, (700, 2)) * 2) / 2, rng.integers(-7, 14, (200, 2))]).tolist()
    df = spark.createDataFrame(pd.DataFrame(pts, columns=["x", "y"]))
    got = {(r.x, r.y, r.unit_id) for r in spatial.points_in_units(df, spark.createDataFrame(edges, EDGES), "x", "y", tile).collect()}
    want = inside(edges, {tuple(p) for p in pts})
    assert got == want and len({u for *_, u in want}) == 9


def test_only_edges_of_the_own_tile_are_compared(spark):
    """A ragged coast far to the east in the same band adds no row to a point's comparison."""
    def compared(teeth):
        coast = [(50 + (i % 2) * 0.01, 0.5 + i / teeth) for i in range(teeth)]
        e = spark.createDataFrame(ring(1, [(0.2, 0.5), *coast, (0.2, 1.5)]), EDGES)
        df = spark.createDataFrame([(0.1 + i / 100, 0.7) for i in range(50)], "x double, y double")
        met = spatial.points_in_units(df, e, "x", "y")
        assert met.count() == 40
        local = spatial.corner_parity(e).filter("__edge and __tx = 0 and __ty = 0")
        return local.count(), e.filter("least(x1, x2) < 1 and least(y1, y2) < 1").count()
    assert compared(20) == compared(2000) == (1, 2)


def test_stored_boxes_need_no_shuffle(spark):
    rng = np.random.default_rng(2)
    lines, outlines = [], []
    for key in range(6):
        walk = (np.cumsum(rng.uniform(-2e5, 2e5, (30, 2)), axis=0) + rng.uniform(-1e6, 1e6, 2)).tolist()
        lines += [(key, *a, *b) for a, b in zip(walk, walk[1:])]
        outlines += star(key, rng, 200, rng.uniform(-1e6, 1e6, 2), 2e5, 4e5)
    names, ddl = [f"boxes_{uuid.uuid4().hex}" for _ in range(2)], EDGES.replace("unit_id", "k")
    try:
        sides = [spark.createDataFrame(data, ddl) for data in (lines, outlines)]
        kept = [write_by_key(spatial.segment_boxes(df, "k", m, (1e6, 1.5e5)), n, ["k"], 8) for df, m, n in zip(sides, "ab", names)]
        got = spatial.box_distance(*kept, "k")
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") <= 6 and "Exchange hash" not in plan
        want = {r.k: r.distance for r in spatial.set_distance(*sides, "k", cells=(1e6, 1.5e5)).collect()}
        assert {r.k: r.distance for r in got.collect()} == want and len(want) == 6
    finally:
        for n in names:
            spark.sql(f"DROP TABLE IF EXISTS {n}")


def test_distance_of_nested_lines_is_zero(spark):
    outline = ring(1, [(0, 0), (10, 0), (10, 10), (0, 10)]) + ring(2, [(0, 0), (10, 0), (10, 10), (0, 10)])
    lines = [(1, 4.0, 4.0, 5.0, 5.0), (1, 5.0, 5.0, 6.0, 4.0), (2, 12.0, 5.0, 12.0, 5.0)]
    ddl = EDGES.replace("unit_id", "k")
    got = spatial.set_distance(spark.createDataFrame(lines, ddl), spark.createDataFrame(outline, ddl), "k", cells=(16.0, 2.0))
    assert {r.k: r.distance for r in got.collect()} == {1: 0.0, 2: 2.0}
