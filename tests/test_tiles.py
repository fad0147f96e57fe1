"""Blocked array tables: packing, stacking without shuffles, windows cut from tiles."""

import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from squallframe.operators import raster, tiles, windows
from squallframe.operators.tiles import Tiling, from_tiles, stack_tiles, tile_windows, to_tiles, zone_sums
from squallframe.sources.sinks import write_tiles

TILING = Tiling(8, 16)


@pytest.fixture(scope="module")
def layer(spark):
    rng = np.random.default_rng(3)
    row, col = np.mgrid[-5:40, 0:50]
    pdf = pd.DataFrame({"row": row.ravel(), "col": col.ravel(), "value": rng.normal(size=row.size), "zone": rng.integers(0, 4, row.size)})
    return spark.createDataFrame(pdf[rng.random(row.size) < 0.8]).cache()


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_tiles_hold_the_cells(spark, layer):
    packed = to_tiles(layer, ["value", "zone"], TILING)
    assert {len(r.value) for r in packed.collect()} == {128}
    assert rows(from_tiles(packed, ["value", "zone"], TILING), "row", "col", "value", "zone") == rows(layer, "row", "col", "value", "zone")
    moved = from_tiles(to_tiles(layer, ["value"], TILING, origin=(3, -7)), ["value"], TILING)
    assert rows(moved, "row", "col", "value") == rows(layer.select(F.col("row") + 3, F.col("col") - 7, "value").toDF("row", "col", "value"), "row", "col", "value")
    assert to_tiles(layer.limit(0), ["value"], TILING).count() == 0


def test_a_cell_given_twice_fails(layer):
    with pytest.raises(Exception, match="twice"):
        to_tiles(layer.unionByName(layer.limit(1)), ["value"], TILING).collect()


def test_stacking_bucketed_layers_moves_nothing(spark, layer):
    names = [f"layer_{uuid.uuid4().hex}" for _ in range(2)]
    other = layer.withColumn("value", -F.col("value")).filter("col < 20")
    try:
        base, top = (write_tiles(to_tiles(df, ["value"], TILING, origin=(18, 0), buckets=8), n, 8) for df, n in zip((layer, other), names))
        stacked = stack_tiles(base, {"pop": top})
        plan = stacked._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        want = raster.stack_layers(layer.select("row", "col", "value"), {"pop": other.withColumn("row", F.col("row") + 18).select("row", "col", "value")}, row_offset=18)
        got = from_tiles(stacked, ["value", "pop"], TILING).filter("value is not null")
        key = lambda r: (r[0], r[1])
        assert sorted(map(tuple, got.select("row", "col", "value", "pop").collect()), key=key) == sorted(map(tuple, want.select("row", "col", "value", "pop").collect()), key=key)
        # Windows send their anchors: the layer itself is read where it lies.
        cut = tile_windows(spark.createDataFrame([(1, 20, 9)], "id int, row long, col long"), base, TILING, size=3, factor=4)
        text = cut._jdf.queryExecution().executedPlan().toString()
        lines = text.splitlines()
        scan = next(i for i, line in enumerate(lines) if "FileScan" in line)
        depth = lambda line: len(line) - len(line.lstrip(" :+-"))
        at, path = depth(lines[scan]), []
        for line in reversed(lines[:scan]):
            if depth(line) < at:
                at = depth(line)
                path.append(line)
                if "SortMergeJoin" in line:
                    break
        assert "SortMergeJoin" in path[-1] and not any("Exchange" in p for p in path)
    finally:
        for n in names:
            spark.sql(f"DROP TABLE IF EXISTS {n}")


@pytest.mark.parametrize("method", ["sum", "mean"])
def test_windows_from_tiles_equal_windows_from_cells(spark, layer, method, monkeypatch):
    monkeypatch.setattr(tiles, "ANCHORS", 3)
    spots = [(i, int(r), int(c)) for i, (r, c) in enumerate(np.random.default_rng(5).integers(-20, 60, (25, 2)))] + [(90, 8, 16), (91, 8, 16), (92, 7, 15)]
    anchors = spark.createDataFrame(spots, "id int, row long, col long")
    packed = to_tiles(layer, ["value", "zone"], TILING)
    for size, factor, flip in ((3, 4, True), (5, 7, False), (2, 1, True)):
        want = windows.extract_windows(anchors, layer.select("row", "col", "value"), method=method, size=size, factor=factor, flip=flip)
        got = tile_windows(anchors, packed, TILING, method=method, size=size, factor=factor, flip=flip)
        a, b = (df.select("id", F.col("wi").cast("int").alias("wi"), F.col("wj").cast("int").alias("wj"), F.round("value", 9).alias("value")) for df in (want, got))
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    aimed = anchors.withColumn("target", F.col("id") % 4)
    want = windows.zone_share_windows(aimed, layer.select("row", "col", "zone"), size=3, factor=4)
    got = tile_windows(aimed, packed, TILING, "zone", size=3, factor=4, target="target")
    a, b = (df.select("id", F.col("wi").cast("int").alias("wi"), F.col("wj").cast("int").alias("wj"), F.round("share", 9).alias("share")) for df in (want, got))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_zone_sums_from_tiles(layer):
    got = zone_sums(to_tiles(layer, ["value", "zone"], TILING), "value")
    want = layer.filter("zone > 0").groupBy("zone").agg(F.sum("value").alias("total"))
    assert [(r.zone, pytest.approx(r.total)) for r in want.orderBy("zone").collect()] == [(r.zone, r.total) for r in got.orderBy("zone").collect()]
