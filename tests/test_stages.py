"""Neighbours by occupied cubes, stage tables, lookups and logs on small fixtures."""

import math
import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from squallframe.operators import external, keyed, quality, stats
from squallframe.operators.ranges import distance_join, has_neighbour
from squallframe.sources.readers import country_lookup
from squallframe.sources.sinks import save_table


@pytest.mark.parametrize("within", [30.0, 400.0, 3000.0])
def test_neighbours_against_all_pairs(spark, within):
    rng = np.random.default_rng(int(within))
    centres = np.array([[0.0, 179.9], [89.5, 10.0], [20.0, 120.0], [-60.0, -30.0]])
    spread = within / 111.0
    make = lambda n: np.clip(centres[rng.integers(0, 4, n)] + rng.normal(0, spread, (n, 2)), [-90, -400], [90, 400])
    left, right = make(150), make(60)
    left[:5] = right[:5]
    day = lambda n: rng.integers(0, 2, n)
    a = pd.DataFrame({"k": day(150), "id": range(150), "lat": left[:, 0], "lon": left[:, 1]})
    b = pd.DataFrame({"k": day(60), "lat": right[:, 0], "lon": right[:, 1]})

    def km(p, q):
        p1, l1, p2, l2 = map(math.radians, (p.lat, p.lon, q.lat, q.lon))
        h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin((l2 - l1) / 2) ** 2
        return 2 * 6371.0088 * math.atan2(math.sqrt(h), math.sqrt(1 - h))
    want = {p.id for p in a.itertuples() if any(q.k == p.k and km(p, q) <= within for q in b.itertuples())}
    got = has_neighbour(spark.createDataFrame(a), spark.createDataFrame(b), ("lat", "lon"), ("lat", "lon"), within, ["k"])
    assert got.columns == list(a.columns) and sorted(r.id for r in got.collect()) == sorted(want) and 0 < len(want) < 150


def test_dense_cubes_are_not_paired(spark):
    """Two crowds in one place settle by their cubes: no row is compared with another."""
    rng = np.random.default_rng(1)
    crowd = spark.createDataFrame(pd.DataFrame(rng.uniform(0, 0.05, (3000, 2)) + 10, columns=["lat", "lon"]))
    got = has_neighbour(crowd, crowd, ("lat", "lon"), ("lat", "lon"), 100.0)
    assert got.count() == 3000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_rows_that_multiply_are_never_broadcast(spark):
    """Spark takes exploded cubes for as small as the points they come from; a join must not send them to every executor."""
    crowd = spark.range(2000).select((F.col("id") % 40).cast("double").alias("lat"), F.floor(F.col("id") / 40).cast("double").alias("lon"))
    other = spark.range(50).select((F.col("id") % 10 + 0.3).alias("lat2"), F.floor(F.col("id") / 10).cast("double").alias("lon2"))
    left, right = crowd.distinct(), other.distinct()
    near = has_neighbour(left, right, ("lat", "lon"), ("lat2", "lon2"), 40.0)
    pairs = distance_join(left, right, ("lat", "lon"), ("lat2", "lon2"), 40.0)
    assert near.count() == pairs.select("lat", "lon").distinct().count() == 50
    for got in (near, pairs):
        depths = []
        for line in got._jdf.queryExecution().executedPlan().toString().split("\n"):
            depth = len(line) - len(line.lstrip(" :+-*("))
            depths = [d for d in depths if d < depth] + [depth] * ("BroadcastExchange" in line)
            assert not (depths and "Generate explode" in line), line


def test_equal_sums_in_another_order_are_equal(spark):
    """0.1 + 0.2 is 0.3: cells and days that tie do so however they were added up."""
    parts = {(0, 0): (0.1, 0.2, 0.3), (0, 1): (0.3, 0.2, 0.1), (1, 0): (0.2, 0.3, 0.1), (1, 1): (0.0, 0.0, 0.6), (2, 0): (0.0, 0.0, 0.1)}
    rows = [("e", d, i, j, v, v) for (i, j), days in parts.items() for d, v in enumerate(days)]
    means = spark.createDataFrame(rows, "event string, d int, wi int, wj int, ours double, theirs double").withColumn("day", F.date_add(F.lit("2020-01-01").cast("date"), F.col("d")))
    footprint, _ = external.event_totals(means.coalesce(1), "event", ["ours", "theirs"], "day")
    assert {r.ours for r in footprint.collect()} == {0.6, 0.1}
    masks = stats.top_share_masks(footprint, ["event"], "ours", "theirs", 0.2)
    assert masks.filter("top_a").count() == masks.filter("top_b").count() == 4


def test_distances_do_not_show_the_order_of_addition(spark):
    values = [1.6, 9.9, 17.7, 9.9, 11.1]  # the first lies at exactly -1.6484375
    rows = [(k, values[(k + s) % 5]) for k in range(40) for s in range(5)] + [(k + 40, values[(k - s) % 5]) for k in range(40) for s in range(5)]
    got = stats.sigma_flags(spark.createDataFrame(rows, "k int, v double"), ["k"], "v", 1.6484375)
    assert {(r.z_score, r.flagged) for r in got.filter("v = 1.6").collect()} == {(-1.6484375, 0)}


def test_best_per_key_is_first_per_key(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame(pd.DataFrame({"k": rng.integers(0, 9, 400), "a": rng.integers(0, 4, 400), "b": rng.integers(0, 3, 400), "id": range(400)}))
    order = [-F.col("a"), F.col("b"), F.col("id")]
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    assert rows(keyed.best_per_key(df, ["k"], order)) == rows(keyed.first_per_key(df, ["k"], order))


def test_lookup_refuses_other_columns(spark):
    ok = spark.createDataFrame([(" chn", 3), ("CHN ", 2), ("usa", 1)], "iso3_final string, country_id int")
    assert sorted(map(tuple, country_lookup(ok).collect())) == [("CHN", 3), ("USA", 1)]
    with pytest.raises(ValueError, match="country lookup columns"):
        country_lookup(ok.withColumnRenamed("country_id", "id"))


@pytest.mark.parametrize(("fmt", "options"), [("csv", {"header": "true", "escape": '"'}), ("json", {}), ("parquet", {})])
def test_tables_come_back_as_written(spark, fmt, options):
    df = spark.createDataFrame([(1, 'a, "b"', 1.5), (2, None, None), (3, "é", -0.25)], "i int, s string, v double")
    name = f"kept_{uuid.uuid4().hex}"
    try:
        assert sorted(map(tuple, save_table(df, name, fmt, **options).collect())) == sorted(map(tuple, df.collect()))
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_denominators_and_their_logs(spark):
    weights = spark.createDataFrame([(1, 2000, 5.0), (1, 2001, 0.0), (2, 2000, None), (2, 2001, 3.0)], "zone int, year int, denominator double")
    totals = spark.createDataFrame([(1, 2000, 10.0), (1, 2001, 20.0), (2, 2000, 0.0)], "zone int, year int, total double")
    table = quality.denominator_table(weights, totals, spark.createDataFrame([(1, "AAA"), (2, "BBB")], "zone int, iso3 string"))
    got = {(r.zone, r.year): (r.denominator, r.total, r.is_missing, r.positive_with_zero_denominator) for r in table.collect()}
    assert got == {(1, 2000): (5.0, 10.0, 0, False), (1, 2001): (0.0, 20.0, 0, True), (2, 2000): (0.0, 0.0, 0, False), (2, 2001): (3.0, 0.0, 1, False)}
    assert sorted((r.zone, r.year, r.log) for r in quality.denominator_logs(table).collect()) == [(1, 2001, "zero_denominator"), (2, 2001, "missing_total")]
    spread = table.withColumn("spread", F.when(F.col("denominator") > 0, F.col("total")).otherwise(0.0))
    row = quality.qa_summary(spread, "spread").first()
    assert (row.first_year, row.last_year, row.missing_count, row.zero_denominator_count) == (2000, 2001, 1, 1)
    assert row.max_total_rel_error == 1.0 and row.mean_total_rel_error == 0.5


def test_planned_samples_without_a_raster_fail(spark):
    checked = spark.createDataFrame([(1, "a", 0.5, 3, 1, "PASS")], "s int, variable string, mae double, valid_cells long, orientation_pass int, status string")
    planned = spark.createDataFrame([(1, "a", "/a.tif"), (1, "b", "/b.tif"), (2, "a", "/a.tif")], "s int, variable string, path string")
    got = {(r.s, r.variable): (r.mae, r.valid_cells, r.status, r.note) for r in quality.with_missing_rasters(checked, planned, ["s"]).collect()}
    assert got == {(1, "a"): (0.5, 3, "PASS", ""), (1, "b"): (None, 0, "FAIL", "missing_raster:/b.tif"), (2, "a"): (None, 0, "FAIL", "missing_raster:/a.tif")}
