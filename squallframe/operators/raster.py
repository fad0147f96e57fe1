"""Algebra over cell tables (row, col, value) of gridded layers."""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.sinks import write_observed
from .keyed import join_keys, with_scalars

# The tile function travels with the plan, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def zone_sums(cells: DataFrame, weight: Column, zone: str = "zone", by: Sequence[str] = (),
              out: str = "total") -> DataFrame:
    """Weighted sum per zone; zone ids start at 1."""
    return cells.filter(F.col(zone) > 0).groupBy(*by, zone).agg(F.sum(weight).alias(out))


def stack_layers(base: DataFrame, others: dict[str, DataFrame], by: Sequence[str] = (),
                 row_offset: int = 0) -> DataFrame:
    """Cells of a base layer beside aligned layers; base rows start ``row_offset`` rows down."""
    out = base.withColumn("row", F.col("row") + row_offset)
    for name, layer in others.items():
        out = out.join(layer.select(*by, "row", "col", F.col("value").alias(name)), [*by, "row", "col"], "left")
    return out


def disaggregate(cells: DataFrame, totals: DataFrame, weight: Column, total: str, zone: str = "zone",
                 by: Sequence[str] = (), out: str = "asset") -> DataFrame:
    """Spread each zone's total over its cells in proportion to the weight; else zero.

    Sums are taken over all zones and met null-safely, so that no filter reaches the cells of one
    branch alone and both read the same exchanges; zones that do not count get nothing.
    """
    keys = [*by, zone]
    weighted = cells.withColumn("__w", weight)
    sums = weighted.groupBy(*keys).agg(F.sum("__w").alias("__zone_w"))
    share = F.when((F.col(zone) > 0) & (F.col("__w") > 0) & (F.col("__zone_w") > 0) & (F.col(total) > 0),
                   F.col(total) * F.col("__w") / F.col("__zone_w")).otherwise(F.lit(0.0))
    rest = [c for c in weighted.columns if c not in keys]
    return (join_keys(weighted, sums, keys, "left").select(*keys, *rest, "__zone_w").join(totals, keys, "left")
            .withColumn(out, share).drop("__w", "__zone_w"))


def weighted_composite(cells: DataFrame, value: str, weight: str, keys: Sequence[str],
                       out: str = "value") -> DataFrame:
    """Weighted mean over the valid pairs of a cell; no weight gives zero."""
    ok = F.col(value).isNotNull() & F.col(weight).isNotNull()
    mass = F.sum(F.when(ok, F.col(weight)))
    return cells.groupBy(*keys).agg(
        F.when(mass > 0, F.sum(F.when(ok, F.col(value) * F.col(weight))) / mass)
        .otherwise(F.lit(0.0)).alias(out))


def resample(cells: DataFrame, row_ratio: float, col_ratio: float, method: str = "average",
             by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Snap source cell centres to a coarser target grid and reduce per target cell."""
    r = (F.col("row") + 0.5) / F.lit(float(row_ratio))
    c = (F.col("col") + 0.5) / F.lit(float(col_ratio))
    snapped = cells.withColumn("__r", F.floor(r)).withColumn("__c", F.floor(c))
    if method == "nearest":
        dr, dc = r - F.floor(r) - 0.5, c - F.floor(c) - 0.5
        order = F.struct((dr * dr + dc * dc), F.col("row"), F.col("col"))
        reduced = F.min_by(value, order)
    else:
        reduced = {"average": F.avg, "sum": F.sum}[method](value)
    return (snapped.groupBy(*by, "__r", "__c").agg(reduced.alias(value))
            .withColumnsRenamed({"__r": "row", "__c": "col"}))


def overlaps(index: Column, ratio: float, start: float = 0.0) -> Column:
    """Target cells a source cell meets along one axis, with the share of the source cell that lies in each.

    A target cell spans ``ratio`` source cells, the first of them begins at the source position ``start``.
    """
    low, high = (index - F.lit(float(start))) / F.lit(float(ratio)), (index + 1 - F.lit(float(start))) / F.lit(float(ratio))
    met = F.sequence(F.floor(low), F.greatest(F.ceil(high) - 1, F.floor(low)))
    shares = F.transform(met, lambda k: F.struct(k.alias("to"), ((F.least(high, k + 1) - F.greatest(low, k)) * F.lit(float(ratio))).alias("w")))
    return F.explode(F.filter(shares, lambda s: s["w"] > 0))


def overlap_resample(cells: DataFrame, row_axis: tuple[float, float], col_axis: tuple[float, float], method: str = "average", by: Sequence[str] = (),
                     value: str = "value", extent: tuple[int, int] | None = None) -> DataFrame:
    """Regrid by area: an ``average`` over the valid part of each target cell, or a ``sum`` that keeps the total.

    Axes are (source cells to a target cell, source position of the target's edge), at any ratio, up or down. Weights
    are one-dimensional, so cells are reduced along their row first and the rows after that: a cell is repeated by the
    targets it meets along one axis at a time. ``extent`` (rows, cols) cuts the target. Missing cells weigh nothing;
    a target without a valid cell is absent.
    """
    inside = F.lit(True) if extent is None else F.col("__c.to").between(0, extent[1] - 1)
    across = (cells.filter(F.col(value).isNotNull()).select(*by, "row", F.col(value).cast("double").alias("__v"), overlaps(F.col("col"), *col_axis).alias("__c"))
              .filter(inside).groupBy(*by, "row", F.col("__c.to").alias("col")).agg(F.sum(F.col("__c.w") * F.col("__v")).alias("__s"), F.sum("__c.w").alias("__w")))
    below = F.lit(True) if extent is None else F.col("__r.to").between(0, extent[0] - 1)
    total, weight = F.sum(F.col("__r.w") * F.col("__s")), F.sum(F.col("__r.w") * F.col("__w"))
    return (across.select(*by, "col", "__s", "__w", overlaps(F.col("row"), *row_axis).alias("__r")).filter(below)
            .groupBy(*by, F.col("__r.to").alias("row"), "col").agg({"average": total / weight, "sum": total}[method].alias(value)))


def mosaic(cells: DataFrame, order: Sequence[str], by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """One layer from overlapping files: where several have a valid cell, the first file by ``order`` wins."""
    first = F.min_by(value, F.struct(*order, value))
    return cells.filter(F.col(value).isNotNull()).groupBy(*by, "row", "col").agg(first.alias(value))


def downsample(cells: DataFrame, factor: int, by: Sequence[str] = (), value: str = "value") -> DataFrame:
    return resample(cells, factor, factor, "average", by, value)


def raster_stats(cells: DataFrame, value: str = "value", by: Sequence[str] = ()) -> DataFrame:
    """Moments of the valid cells of a layer in one pass."""
    v = F.col(value).cast("double")
    finite = F.when(~F.isnan(v) & (F.abs(v) != F.lit(math.inf)), v)
    return cells.groupBy(*by).agg(
        F.min(finite).alias("min"), F.max(finite).alias("max"), F.avg(finite).alias("mean"),
        F.stddev_pop(finite).alias("std"), F.avg((finite <= 0).cast("double")).alias("zero_fraction"),
        F.count(finite).alias("n_valid"),
        F.count_if(v.isNotNull() & finite.isNull()).alias("n_nonfinite"),
        F.coalesce(F.sum(finite), F.lit(0.0)).alias("total"))


def high_latitude_threshold(cells: DataFrame, lat: Column, value: str = "value", min_abs_lat: float = 45.0,
                            sigmas: float = 3.0, min_count: int = 1000, by: Sequence[str] = ()) -> DataFrame:
    """mean + 3 sigma of positive high-latitude cells, for each year or other group of ``by``; too few cells give no limit."""
    v = F.when((F.col(value) > 0) & (F.abs(lat) >= min_abs_lat), F.col(value))
    got = cells.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"))
    limit = F.when(F.col("n") < min_count, F.lit(math.inf)).otherwise(F.col("mean") + sigmas * F.col("std"))
    return got.select(*by, "n", limit.alias("threshold"))


def denoised(value: Column, lat: Column, threshold: Column, floor: float = 0.3,
             min_abs_lat: float = 45.0) -> tuple[Column, Column]:
    """Denoised value and the rule that removed it (NULL when kept)."""
    rule = (F.when(value < 0, F.lit("negative"))
            .when((value > 0) & (value < floor), F.lit("low"))
            .when((F.abs(lat) >= min_abs_lat) & (value > threshold), F.lit("high_latitude")))
    return F.when(rule.isNotNull(), F.lit(0.0)).otherwise(value), rule


RULES = ("negative", "low", "high_latitude")


def write_denoised(cells: DataFrame, value: str, lat: Column, year: str, threshold: str = "threshold"):
    """A function that writes the denoised layer to a table and returns, for each year, its cells, what each rule removed and the total kept.

    Every year is held against its own ``threshold`` column. The counters are observed on the rows on their way to the
    writer, so layer and counters come from one scan. The years are few and known before.
    """
    clean, rule = denoised(F.col(value), lat, F.col(threshold))
    years = sorted(r[0] for r in cells.select(year).distinct().collect())
    out = cells.withColumn("__rule", rule).withColumn(value, clean)
    counters = {}
    for y in years:
        here = F.col(year) == y
        counters[f"n_{y}"] = F.count_if(here)
        counters |= {f"{r}_{y}": F.count_if(here & (F.col("__rule") == r)) for r in RULES}
        counters[f"total_{y}"] = F.coalesce(F.sum(F.when(here, F.col(value))), F.lit(0.0))

    def write(table: str) -> dict:
        got = write_observed(out, table, counters)
        return {y: (got[f"n_{y}"], *[got[f"{r}_{y}"] for r in RULES], got[f"total_{y}"]) for y in years}
    return write


def gaussian_kernel(sigma: float, radius: int | None = None) -> list[float]:
    reach = int(4.0 * sigma + 0.5) if radius is None else radius
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    return [w / sum(raw) for w in raw]


def _blur_tile(values: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Separable convolution of a tile that carries a halo as wide as the kernel's reach."""
    reach = len(kernel) // 2
    height, width = values.shape[0] - 2 * reach, values.shape[1] - 2 * reach
    across = sum(w * values[:, k:k + width] for k, w in enumerate(kernel))
    return sum(w * across[k:k + height, :] for k, w in enumerate(kernel))


def gaussian_blur(cells: DataFrame, rows: Column, cols: Column, sigma: float = 1.2,
                  value: str = "value", by: Sequence[str] = (), tile: int = 256) -> DataFrame:
    """Gaussian blur with reflected edges; missing cells count as zero.

    A cell goes to its own tile and to the few neighbours whose halo it lies in, so the one
    shuffle carries little more than the grid itself (an exploded kernel would carry eleven
    rows per cell, twice). A tile has at most (tile + 2 reach)^2 cells, whatever the grid.
    ``rows`` and ``cols`` give the grid's size, which must be at least the kernel's reach.
    """
    kernel = np.array(gaussian_kernel(sigma))
    reach = len(kernel) // 2
    schema = T.StructType([*[cells.schema[c] for c in by], T.StructField("row", T.LongType()),
                           T.StructField("col", T.LongType()), T.StructField(value, T.DoubleType())])

    def tiles_of(index: Column, n: Column) -> Column:
        low = F.floor(F.greatest(index - reach, F.lit(0)) / tile)
        return F.explode(F.sequence(low, F.floor(F.least(index + reach, n - 1) / tile)))

    def mirrored(index: np.ndarray, n: int) -> np.ndarray:
        folded = np.mod(index, 2 * n)
        return np.where(folded < n, folded, 2 * n - 1 - folded)

    def blur(key, pdf):
        tile_row, tile_col, n_rows, n_cols = (int(k) for k in key[len(by):])
        top, left = tile_row * tile, tile_col * tile
        height, width = min(tile, n_rows - top), min(tile, n_cols - left)
        halo = np.zeros((height + 2 * reach, width + 2 * reach))
        halo[pdf["row"].to_numpy() - top + reach, pdf["col"].to_numpy() - left + reach] = pdf[value].to_numpy()
        r = mirrored(np.arange(top - reach, top + height + reach), n_rows) - top + reach
        c = mirrored(np.arange(left - reach, left + width + reach), n_cols) - left + reach
        out = _blur_tile(halo[np.ix_(r, c)], kernel)
        rr, cc = np.mgrid[top:top + height, left:left + width]
        fixed = {name: key[i] for i, name in enumerate(by)}
        return pd.DataFrame({**fixed, "row": rr.ravel(), "col": cc.ravel(), value: out.ravel()})

    spread = (cells.select(*by, "row", "col", F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias(value),
                           rows.cast("long").alias("__rows"), cols.cast("long").alias("__cols"))
              .withColumn("__tr", tiles_of(F.col("row"), F.col("__rows")))
              .withColumn("__tc", tiles_of(F.col("col"), F.col("__cols"))))
    return spread.groupBy(*by, "__tr", "__tc", "__rows", "__cols").applyInPandas(blur, schema)


def non_decreasing(series: DataFrame, keys: Sequence[str], year: str, value: str, low: float = 0.0,
                   high: float = 63.0, tolerance: float = 0.0, blend: float | None = None) -> DataFrame:
    """Yearly series that never falls by more than ``tolerance``; one cell has at most a few
    dozen years, so its years are folded in one row.

    A falling value is replaced by the corrected previous year, or by a blend with weight
    ``blend`` on it. A year whose predecessor is missing passes through unchanged.
    """
    years = F.array_sort(F.collect_list(F.struct(F.col(year).alias("y"), F.col(value).alias("v"))))
    start = F.struct(F.lit(None).cast("double").alias("prev"), F.array().cast(
        "array<struct<y:bigint,v:double,corrected:double,changed:boolean>>").alias("out"))

    def fold(state, item):
        prev, v = state["prev"], item["v"]
        falls = prev.isNotNull() & v.isNotNull() & (v + F.lit(tolerance) < prev)
        target = prev if blend is None else v + F.lit(blend) * (prev - v)
        fixed = F.when(falls, target).otherwise(v)
        fixed = F.when(v.isNotNull(), F.least(F.greatest(fixed, F.lit(low)), F.lit(high)))
        row = F.struct(item["y"].cast("long").alias("y"), v.alias("v"), fixed.alias("corrected"),
                       F.coalesce(falls, F.lit(False)).alias("changed"))
        return F.struct(fixed.alias("prev"), F.concat(state["out"], F.array(row)).alias("out"))

    folded = series.groupBy(*keys).agg(years.alias("__years"))
    unrolled = folded.select(*keys, F.explode(F.aggregate("__years", start, fold)["out"]).alias("__o"))
    return unrolled.select(*keys, F.col("__o.y").alias(year), F.col("__o.v").alias(value),
                           F.col("__o.corrected").alias("corrected"), F.col("__o.changed").alias("changed"))


def corrected_year(state: DataFrame, layer: DataFrame, keys: Sequence[str], value: str, low: float = 0.0, high: float = 63.0,
                   tolerance: float = 0.0, blend: float | None = None) -> tuple[DataFrame, DataFrame]:
    """One more year of ``non_decreasing``, from what the years before it left: (the year's cells, the new state).

    ``state`` holds (keys, last), each cell's last corrected value; ``layer`` holds (keys, value) of the new year. Only these two
    are read, however many years came before. Cells the new year lacks keep their state, cells without a past pass through.
    """
    met = join_keys(layer.select(*keys, F.col(value).cast("double").alias(value)), state.select(*keys, "last"), keys, "left")
    v, prev = F.col(value), F.col("last")
    falls = prev.isNotNull() & v.isNotNull() & (v + F.lit(tolerance) < prev)
    fixed = F.when(falls, prev if blend is None else v + F.lit(blend) * (prev - v)).otherwise(v)
    fixed = F.when(v.isNotNull(), F.least(F.greatest(fixed, F.lit(low)), F.lit(high)))
    year = met.select(*keys, value, fixed.alias("corrected"), F.coalesce(falls, F.lit(False)).alias("changed"))
    gone = state.join(layer.select(*keys).distinct(), list(keys), "left_anti").select(*keys, "last")
    return year, year.select(*keys, F.col("corrected").alias("last")).unionByName(gone)


def running_maximum(series: DataFrame, keys: Sequence[str], year: str, value: str, low: float = 0.0,
                    high: float = 63.0) -> DataFrame:
    """The same for complete layers without tolerance: a running maximum over a cell's years."""
    seen = Window.partitionBy(*keys).orderBy(year).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    top = F.max(value).over(seen)
    return series.withColumn("corrected", F.least(F.greatest(top, F.lit(low)), F.lit(high)))


def year_js_distances(cells: DataFrame, year: str, value: str = "value", **options) -> DataFrame:
    """Histogram distance of every year to the following one."""
    side = F.explode(F.array(F.struct(F.col(year).alias("y"), F.lit(0).alias("side")), F.struct((F.col(year) - 1).alias("y"), F.lit(1).alias("side"))))
    both = cells.select(F.col(value).alias("__v"), side.alias("__p")).select("__v", F.col("__p.y").alias("year"), F.col("__p.side").alias("__side"))
    return js_distance(both, "__side", 0, 1, "__v", by=["year"], **options).filter("n_a > 0 and n_b > 0")


def js_distance(cells: DataFrame, group: str, a, b, value: str = "value", low: float = 0.0,
                high: float = 63.0, bins: int = 256, by: Sequence[str] = ()) -> DataFrame:
    """Jensen-Shannon distance of two groups' histograms; out-of-range values are dropped."""
    v = F.col(value)
    inside = cells.filter(v.between(low, high) & F.col(group).isin(a, b))
    slot = F.least(F.floor((v - low) / F.lit(high - low) * bins), F.lit(bins - 1)).cast("int")
    counts = inside.groupBy(*by, slot.alias("__bin")).agg(
        F.count_if(F.col(group) == a).alias("__a"), F.count_if(F.col(group) == b).alias("__b"))
    tiny = 1e-12
    # At most ``bins`` rows per pair are left. Bins empty on both sides carry only the smoothing.
    totals = counts.groupBy(*by).agg(F.sum("__a").alias("n_a"), F.sum("__b").alias("n_b"),
                                     F.count(F.lit(1)).alias("__used"))
    paired = join_keys(counts, totals, by) if by else with_scalars(counts, totals)

    def divergence(a_count, b_count):
        p = (a_count + tiny) / (F.col("n_a") + bins * tiny)
        q = (b_count + tiny) / (F.col("n_b") + bins * tiny)
        m = (p + q) / 2
        return (p * F.log(p / m) + q * F.log(q / m)) / 2

    empty = (F.lit(bins) - F.col("__used")) * divergence(F.lit(0.0), F.lit(0.0))
    total = F.sum(divergence(F.col("__a"), F.col("__b"))) + F.max(empty)
    return paired.groupBy(*by).agg(F.sqrt(F.greatest(total, F.lit(0.0))).alias("js_distance"),
                                   F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"))
