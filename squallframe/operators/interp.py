"""Monotone cubic interpolation in log space over a handful of knots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _interior(d0: Column, d1: Column, h0: float, h1: float) -> Column:
    w0, w1 = 2 * h1 + h0, h1 + 2 * h0
    return F.when(d0 * d1 <= 0, F.lit(0.0)).otherwise((w0 + w1) / (F.lit(w0) / d0 + F.lit(w1) / d1))


def _end(d0: Column, d1: Column, h0: float, h1: float) -> Column:
    m = (d0 * (2 * h0 + h1) - d1 * h0) / (h0 + h1)
    return (F.when(F.signum(m) != F.signum(d0), F.lit(0.0))
            .when((F.signum(d0) != F.signum(d1)) & (F.abs(m) > 3 * F.abs(d0)), 3 * d0).otherwise(m))


def monotone_slopes(values: Sequence[Column], knots: Sequence[float]) -> tuple[list[Column], list[Column]]:
    """Secants and Fritsch-Carlson slopes of three or more knots."""
    steps = [b - a for a, b in zip(knots, knots[1:])]
    secants = [(b - a) / h for a, b, h in zip(values, values[1:], steps)]
    inner = [_interior(secants[k - 1], secants[k], steps[k - 1], steps[k]) for k in range(1, len(steps))]
    return secants, [_end(secants[0], secants[1], steps[0], steps[1]), *inner,
                     _end(secants[-1], secants[-2], steps[-1], steps[-2])]


def log_pchip(layers: DataFrame, keys: Sequence[str], year: str, value: str, knots: Sequence[int],
              first: int, last: int) -> DataFrame:
    """Annual values of each cell from its knot years.

    Knots missing for a cell count as zero; years past the last knot follow the last piece.
    Non-finite results become 0 and negatives are cut.
    """
    wide = layers.groupBy(*keys).agg(*[
        F.log1p(F.greatest(F.coalesce(F.max(F.when(F.col(year) == k, F.col(value))), F.lit(0.0)), F.lit(0.0)))
        .alias(f"__y{i}") for i, k in enumerate(knots)])
    _, slopes = monotone_slopes([F.col(f"__y{i}") for i in range(len(knots))], knots)
    sloped = wide.select("*", *[m.alias(f"__m{i}") for i, m in enumerate(slopes)])
    yearly = sloped.withColumn(year, F.explode(F.sequence(F.lit(first), F.lit(last))))
    pieces = None
    for i in range(len(knots) - 1):
        h = float(knots[i + 1] - knots[i])
        t = (F.col(year) - knots[i]) / h
        t2, t3 = t * t, t * t * t
        hermite = ((2 * t3 - 3 * t2 + 1) * F.col(f"__y{i}") + (t3 - 2 * t2 + t) * h * F.col(f"__m{i}")
                   + (3 * t2 - 2 * t3) * F.col(f"__y{i + 1}") + (t3 - t2) * h * F.col(f"__m{i + 1}"))
        if i == len(knots) - 2:
            pieces = hermite if pieces is None else pieces.otherwise(hermite)
        else:
            inside = F.col(year) < knots[i + 1]
            pieces = F.when(inside, hermite) if pieces is None else pieces.when(inside, hermite)
    back = F.expm1(pieces)
    finite = F.when(F.isnan(back) | (F.abs(back) == float("inf")), F.lit(0.0)).otherwise(back)
    return yearly.select(*keys, year, F.greatest(finite, F.lit(0.0)).alias(value))


def knot_fidelity(original: DataFrame, rebuilt: DataFrame, keys: Sequence[str], year: str, value: str) -> DataFrame:
    """Difference between the input layers and the rebuilt ones at the knot years."""
    pair = original.select(*keys, year, F.col(value).alias("__in")).join(
        rebuilt.select(*keys, year, F.col(value).alias("__out")), [*keys, year])
    gap = F.abs(F.col("__in") - F.col("__out"))
    return pair.groupBy(year).agg(F.count(F.lit(1)).alias("n"), F.avg(gap).alias("mae"), F.max(gap).alias("max_abs"))
