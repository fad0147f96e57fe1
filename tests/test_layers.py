"""Regridding, yearly state, observed counters, ranged digests, batched fits and quantiles on small fixtures."""

import hashlib
import math
import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from squallframe.operators import fit, quantiles, raster
from squallframe.sources.readers import list_files, sampled_digests
from squallframe.sources.sinks import write_observed


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(9)
    row, col = np.mgrid[0:23, 0:31]
    value = np.where(rng.random(row.size) < 0.1, np.nan, rng.uniform(0, 100, row.size))
    df = spark.createDataFrame(pd.DataFrame({"row": row.ravel(), "col": col.ravel(), "value": value}))
    return df.withColumn("value", F.when(~F.isnan("value"), F.col("value"))).cache()


@pytest.mark.parametrize(("rows", "cols"), [((2.5, 0.0), (3.75, 0.0)), ((0.4, -0.3), (1.7, 2.2)), ((5.0, 1.0), (2.0, -1.0))])
def test_overlap_resample_by_area(cells, rows, cols):
    src = {(r.row, r.col): r.value for r in cells.collect() if r.value is not None}
    want, weight = {}, {}
    for (r, c), v in src.items():
        for tr in range(math.floor((r - rows[1]) / rows[0]), math.floor((r + 1 - rows[1]) / rows[0]) + 1):
            for tc in range(math.floor((c - cols[1]) / cols[0]), math.floor((c + 1 - cols[1]) / cols[0]) + 1):
                w = 1.0
                for i, t, (q, s) in ((r, tr, rows), (c, tc, cols)):
                    w *= max(0.0, min(i + 1, s + (t + 1) * q) - max(i, s + t * q))
                if w > 1e-12:
                    want[tr, tc] = want.get((tr, tc), 0.0) + w * v
                    weight[tr, tc] = weight.get((tr, tc), 0.0) + w
    summed = {(r.row, r.col): r.value for r in raster.overlap_resample(cells, rows, cols, "sum").collect()}
    means = {(r.row, r.col): r.value for r in raster.overlap_resample(cells, rows, cols).collect()}
    assert {k for k, v in summed.items() if v > 1e-9} == {k for k, v in want.items() if v > 1e-9}
    for k, v in want.items():
        assert summed[k] == pytest.approx(v, abs=1e-9) and means[k] == pytest.approx(v / weight[k], abs=1e-9)
    assert sum(summed.values()) == pytest.approx(sum(src.values()), rel=1e-9)
    cut = raster.overlap_resample(cells, rows, cols, "sum", extent=(3, 2)).collect()
    assert {(r.row, r.col) for r in cut} == {k for k in summed if 0 <= k[0] < 3 and 0 <= k[1] < 2}


def test_first_file_wins_where_it_is_valid(spark):
    df = spark.createDataFrame([("b", 0, 0, 1.0), ("a", 0, 0, None), ("a", 0, 1, 5.0), ("b", 0, 1, 6.0), ("c", 2, 2, None)], "f string, row long, col long, value double")
    assert sorted(map(tuple, raster.mosaic(df, ["f"]).collect())) == [(0, 0, 1.0), (0, 1, 5.0)]


@pytest.mark.parametrize("rule", [{}, {"tolerance": 1.0, "blend": 0.5}])
def test_adding_years_equals_the_full_fold(spark, rule):
    rng = np.random.default_rng(4)
    rows = [(c, y, None if rng.random() < 0.15 else float(rng.uniform(-5, 70))) for c in range(40) for y in range(2000, 2008) if rng.random() < 0.85]
    df = spark.createDataFrame(rows, "c long, y long, v double")
    want = {(r.c, r.y): (r.corrected, r.changed) for r in raster.non_decreasing(df, ["c"], "y", "v", **rule).collect()}
    first = raster.non_decreasing(df.filter("y < 2003"), ["c"], "y", "v", **rule)
    got = {(r.c, r.y): (r.corrected, r.changed) for r in first.collect()}
    # A missing value is remembered as such, as in the fold.
    state = first.groupBy("c").agg(F.max(F.struct("y", "corrected")).alias("m")).select("c", F.col("m.corrected").alias("last"))
    for year in range(2003, 2008):
        state = spark.createDataFrame(state.collect(), "c long, last double")
        added, state = raster.corrected_year(state, df.filter(F.col("y") == year), ["c"], "v", **rule)
        got |= {(r.c, year): (r.corrected, r.changed) for r in added.collect()}
    assert got == want


def test_counters_come_with_the_write(spark, cells):
    name = f"observed_{uuid.uuid4().hex}"
    try:
        got = write_observed(cells, name, {"n": F.count(F.lit(1)), "missing": F.count_if(F.col("value").isNull()), "total": F.sum("value")})
        back = spark.table(name).agg(F.count(F.lit(1)), F.count_if(F.col("value").isNull()), F.sum("value")).first()
        assert (got["n"], got["missing"]) == tuple(back)[:2] and got["total"] == pytest.approx(back[2])
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_thresholds_and_counters_by_year(spark):
    rows = [(y, 60.0, v) for y, scale in ((1, 1.0), (2, 10.0)) for v in [scale] * 30 + [scale * 50, -1.0, 0.1]]
    df = spark.createDataFrame(rows, "y long, lat double, v double")
    limits = raster.high_latitude_threshold(df, F.col("lat"), "v", min_count=10, by=["y"])
    name = f"layer_{uuid.uuid4().hex}"
    try:
        got = raster.write_denoised(df.join(limits, "y"), "v", F.col("lat"), "y")(name)
        assert got == {1: (33, 1, 1, 1, 30.0), 2: (33, 1, 1, 1, 300.0)}
        assert {r.y: r.s for r in spark.table(name).groupBy("y").agg(F.sum("v").alias("s")).collect()} == {1: 30.0, 2: 300.0}
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_digests_read_three_ranges_at_any_size(spark, tmp_path):
    part = 1 << 20
    sizes = {"short": 10, "one": part, "two": 2 * part, "three": 3 * part + 5, "huge": 3 << 30}
    for name, size in sizes.items():
        with open(tmp_path / name, "wb") as f:
            f.write(b"head" if size > 10 else b"x" * size)
            f.truncate(size)
            if size > part:
                f.seek(size - 4)
                f.write(b"tail")
    got = {r.path.rsplit("/", 1)[1]: r for r in sampled_digests(list_files(spark, str(tmp_path))).collect()}
    for name, size in sizes.items():
        want = hashlib.sha256(str(size).encode())
        with open(tmp_path / name, "rb") as f:
            for start in [0] + ([size // 2 - part // 2] if size > 2 * part else []) + ([size - part] if size > part else []):
                f.seek(start)
                want.update(f.read(part))
        assert got[name].digest == want.hexdigest() and got[name].length == size and got[name].bytes_read <= 3 * part


def test_fits_of_all_scopes_at_once(spark):
    rng = np.random.default_rng(6)
    rows, planted = [], {2012: (4.0, 50.0, -0.9, 9.0), 2013: (8.0, 40.0, -1.5, 11.0)}
    for year, (a, b, c, d) in planted.items():
        x = rng.uniform(0, 20, 3000)
        rows += zip([year] * 3000, x.tolist(), (a + b / (1 + np.exp(c * (x - d))) + rng.normal(0, 2, 3000)).tolist())
    df = spark.createDataFrame([*rows, (2012, None, 1.0), (2013, 1.0, float("nan"))], "year int, x double, y double")
    got = {r.scope: r for r in fit.fit_sigmoid_scopes(df, "year").collect()}
    assert set(got) == {"2012", "2013", "combined"} and got["combined"].n == 6000
    for scope, r in got.items():
        own = np.array([(x, y) for year, x, y in rows if scope in (str(year), "combined")])

        def gradient(p):
            g = 1 / (1 + np.exp(p[2] * (own[:, 0] - p[3])))
            res = own[:, 1] - p[0] - p[1] * g
            jac = np.stack([np.ones_like(g), g, -p[1] * (own[:, 0] - p[3]) * g * (1 - g), p[1] * p[2] * g * (1 - g)])
            return jac @ res / np.sqrt((jac ** 2).sum(axis=1) * (res ** 2).sum()), res
        slope, res = gradient((r.a, r.b, r.c, r.d))
        assert np.abs(slope).max() < 1e-5 and r.gradient < 1e-5
        assert r.rmse == pytest.approx(np.sqrt((res ** 2).mean())) and r.mae == pytest.approx(np.abs(res).mean())
        assert r.r2 == pytest.approx(1 - (res ** 2).sum() / ((own[:, 1] - own[:, 1].mean()) ** 2).sum())
    for year, p in planted.items():
        r = got[str(year)]
        assert [r.a, r.b, r.c, r.d] == pytest.approx(p, rel=0.1)
    with pytest.raises(ValueError, match="too few"):
        fit.fit_sigmoid_scopes(df.filter("year = 2012 or x < 1"), "year")


def test_quantiles_of_several_columns_at_once(spark):
    rng = np.random.default_rng(7)
    n = 5000
    pdf = pd.DataFrame({"k": np.where(rng.random(n) < 0.5, "hot", rng.integers(0, 5, n).astype(str)), "a": rng.normal(size=n) * 10.0 ** rng.integers(-300, 300, n),
                        "b": np.round(rng.normal(size=n), 1), "c": rng.integers(-3, 3, n).astype(float)})
    pdf.loc[rng.random(n) < 0.2, "b"] = np.nan
    pdf.loc[pdf["k"] == "4", "c"] = np.nan
    df = spark.createDataFrame(pdf).withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in "abc"})
    wanted = {f"{c}{p}": (c, p / 100) for c in "abc" for p in (0, 1, 50, 99, 100)}
    got = {r.k: r for r in quantiles.exact_quantiles_of(df, ["k"], wanted).collect()}
    for k, own in pdf.groupby("k"):
        for name, (c, p) in wanted.items():
            values = own[c].dropna()
            assert got[k][name] == (pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-300) if len(values) else None)


def test_quantiles_of_special_values(spark):
    rows = [(v,) for v in (float("-inf"), -5e-324, -0.0, 0.0, 5e-324, 1.0, 2.0, float("inf"), float("nan"))]
    df = spark.createDataFrame(rows, "v double")
    got = quantiles.exact_quantiles(df, [], "v", {f"q{i}": i / 8 for i in range(9)}).first()
    assert [got[f"q{i}"] for i in range(8)] == [r[0] for r in rows[:8]] and math.isnan(got["q8"])
    assert quantiles.exact_quantiles(df.limit(0), [], "v", {"m": 0.5}).first().m is None
    assert quantiles.exact_quantiles(df.limit(0).withColumn("k", F.lit(1)), ["k"], "v", {"m": 0.5}).count() == 0
