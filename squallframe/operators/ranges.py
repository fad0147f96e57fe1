"""Joins on overlap and distance, rewritten as equi-joins on buckets."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import overlap_days
from ..functions.geo import EARTH_RADIUS_KM, haversine_km


def _months(df: DataFrame, start: str, end: str, mark: str) -> DataFrame:
    month = F.expr("interval 1 month")
    first = F.trunc(F.col(start), "month")
    return (df.filter(F.col(start) <= F.col(end))
            .withColumn(f"__first_{mark}", first)
            .withColumn("__month", F.explode(F.sequence(first, F.trunc(F.col(end), "month"), month))))


def overlap_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str],
                 right_span: tuple[str, str], keys: Sequence[str] = (),
                 out: str = "overlap") -> DataFrame:
    """Pairs whose inclusive date spans meet, with the number of shared days.

    Both sides are spread over the calendar months they touch, so the join has an equi key; a
    pair that shares several months is kept only in the first of them.
    """
    l = _months(left, *left_span, "l")
    r = _months(right, *right_span, "r")
    pairs = l.join(r, [*keys, "__month"]).filter(
        (F.col(left_span[0]) <= F.col(right_span[1])) & (F.col(left_span[1]) >= F.col(right_span[0]))
        & (F.col("__month") == F.greatest("__first_l", "__first_r")))
    days = overlap_days(*[F.col(c) for c in (*left_span, *right_span)])
    return pairs.withColumn(out, days).drop("__month", "__first_l", "__first_r")


def overlap_totals(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str],
                   keys: Sequence[str] = ()) -> DataFrame:
    """Rows of ``left`` that meet any span of ``right``, with n_overlaps, overlap_sum and overlap_max.

    Only distinct spans are paired, whose number the calendar bounds, however many rows share them.
    """
    on = [*keys, *left_span]
    mine = left.select(*on).distinct()
    theirs = right.groupBy(*keys, *right_span).agg(F.count(F.lit(1)).alias("__n"))
    pairs = overlap_join(mine, theirs, left_span, right_span, keys)
    totals = pairs.groupBy(*on).agg(F.sum("__n").alias("n_overlaps"), F.sum(F.col("overlap") * F.col("__n")).alias("overlap_sum"),
                                    F.max("overlap").alias("overlap_max"))
    return left.join(totals, on)


def _cube(lat: str, lon: str, size_km: float):
    la, lo = F.radians(F.col(lat)), F.radians(F.col(lon))
    r = F.lit(EARTH_RADIUS_KM / size_km)
    return (F.floor(r * F.cos(la) * F.cos(lo)), F.floor(r * F.cos(la) * F.sin(lo)), F.floor(r * F.sin(la)))


def distance_join(left: DataFrame, right: DataFrame, left_point: tuple[str, str],
                  right_point: tuple[str, str], within_km: float, keys: Sequence[str] = (),
                  out: str = "km") -> DataFrame:
    """Pairs of (lat, lon) points no farther apart than ``within_km``.

    Points fall into cubes of that edge in Earth-centred space; a chord is never longer than
    its arc, so a hit lies in the same or a neighbouring cube, at poles and date line too.
    """
    axes = ("__x", "__y", "__z")
    l, r = left, right
    for name, value in zip(axes, _cube(*left_point, within_km)):
        l = l.withColumn(name, value)
    for name, value in zip(axes, _cube(*right_point, within_km)):
        r = r.withColumn(name, F.explode(F.sequence(value - 1, value + 1)))
    km = haversine_km(*[F.col(c) for c in (*left_point, *right_point)])
    # The 27 rows of a point pass for one in Spark's estimate, so they are merged and never broadcast.
    return (l.join(r.hint("merge"), [*keys, *axes]).withColumn(out, km)
            .filter(F.col(out) <= within_km).drop(*axes))


def has_neighbour(left: DataFrame, right: DataFrame, left_point: tuple[str, str], right_point: tuple[str, str], within_km: float,
                  keys: Sequence[str] = ()) -> DataFrame:
    """Rows of ``left`` with a point of ``right`` within the distance, each once.

    Cubes whose diagonal is the distance settle most rows: a point in the same occupied cube is a neighbour without being
    looked at. The cubes of the rest name those around them that the globe's surface passes (124 at most), of which the occupied ones are
    met; a cube that lies wholly within reach settles a row too, one out of reach says nothing, and only the distinct points of cubes
    on the border are compared. Spark takes rows that multiply for as small as those they come from, so their joins are
    merged and never broadcast.
    """
    chord = 2 * EARTH_RADIUS_KM * math.sin(min(within_km / EARTH_RADIUS_KM, math.pi) / 2)
    size, axes, near = chord / math.sqrt(3), ("__x", "__y", "__z"), ("__nx", "__ny", "__nz")
    on = [*keys, *axes]

    def placed(df: DataFrame, point: tuple[str, str]) -> DataFrame:
        return df.withColumns(dict(zip(axes, _cube(*point, size))))
    rows = placed(left.filter(F.col(left_point[0]).isNotNull() & F.col(left_point[1]).isNotNull()), left_point)
    points = placed(right.select(*keys, *[F.col(c).alias(f"__{n}") for c, n in zip(right_point, ("lat", "lon"))]).distinct(), ("__lat", "__lon"))
    taken = points.select(*on).distinct()
    same = rows.join(taken, on, "left_semi")
    rest = rows.join(taken, on, "left_anti")
    spots = rest.select(*keys, *left_point, *axes).distinct()
    around = spots.select(*on).distinct()
    for a, n in zip(axes, near):
        around = around.withColumn(n, F.explode(F.sequence(F.col(a) - 2, F.col(a) + 2)))
    middle = F.sqrt(sum(((F.col(n) + 0.5) * size) ** 2 for n in near))
    around = around.filter(F.abs(middle - EARTH_RADIUS_KM) <= chord / 2 * (1 + 1e-6))
    occupied = taken.withColumnsRenamed(dict(zip(axes, near)))
    around = around.join(occupied.hint("merge"), [*keys, *near])
    la, lo = F.radians(F.col(left_point[0])), F.radians(F.col(left_point[1]))
    at = [F.lit(EARTH_RADIUS_KM) * c for c in (F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la))]
    least = sum(((lambda d: d * d)(F.greatest(F.col(n) * size - p, p - (F.col(n) + 1) * size, F.lit(0.0))) for n, p in zip(near, at)), F.lit(0.0))
    most = sum(((lambda d: d * d)(F.greatest((F.col(n) + 1) * size - p, p - F.col(n) * size)) for n, p in zip(near, at)), F.lit(0.0))
    met = (spots.join(around.hint("merge"), on).withColumns({"__least": least, "__most": most})
           .filter(F.col("__least") <= chord ** 2 * (1 + 1e-9)))
    spot = [*keys, *left_point]
    whole = met.filter(F.col("__most") <= chord ** 2 * (1 - 1e-9)).select(*spot).distinct()
    border = met.join(whole, spot, "left_anti").select(*spot, *near)
    others = points.withColumnsRenamed(dict(zip(axes, near)))
    km = haversine_km(*[F.col(c) for c in left_point], F.col("__lat"), F.col("__lon"))
    compared = border.hint("merge").join(others, [*keys, *near]).filter(km <= within_km).select(*spot).distinct()
    found = whole.unionByName(compared)
    return same.unionByName(rest.join(found, spot, "left_semi")).drop(*axes)
