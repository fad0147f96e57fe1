"""Spherical and planar geometry on columns."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Earth radii of the great-circle and the Web-Mercator formulas.
EARTH_RADIUS_KM = 6371.0088
MERCATOR_RADIUS_M = 6378137.0


@dataclass(frozen=True)
class GridSpec:
    """A north-up regular grid; ``lon_res`` defaults to the latitude step."""

    lat_max: float
    lon_min: float
    lat_res: float
    lon_res: float | None = None

    @property
    def step_lon(self) -> float:
        return self.lat_res if self.lon_res is None else self.lon_res

    def row(self, lat: Column) -> Column:
        return F.floor((F.lit(self.lat_max) - lat) / F.lit(self.lat_res)).cast("long")

    def col(self, lon: Column) -> Column:
        return F.floor((lon - F.lit(self.lon_min)) / F.lit(self.step_lon)).cast("long")

    def lat(self, row: Column) -> Column:
        """Latitude of the row centre."""
        return F.lit(self.lat_max) - (row + F.lit(0.5)) * F.lit(self.lat_res)

    def lon(self, col: Column) -> Column:
        return F.lit(self.lon_min) + (col + F.lit(0.5)) * F.lit(self.step_lon)


def valid_coordinate(lat: Column, lon: Column) -> Column:
    ok = (lat.between(-90.0, 90.0)) & (lon.between(-180.0, 180.0)) & ~F.isnan(lat) & ~F.isnan(lon)
    return F.coalesce(ok, F.lit(False))


def wrap_180(lon: Column) -> Column:
    return F.pmod(lon + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def negative_to_360(lon: Column) -> Column:
    """Only negative longitudes move, so a 0..360 source keeps its own convention."""
    return F.when(lon < 0, F.pmod(lon, F.lit(360.0))).otherwise(lon)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_dlat = F.radians(lat2 - lat1) / 2
    half_dlon = F.radians(lon2 - lon1) / 2
    chord = (F.sin(half_dlat) * F.sin(half_dlat)
             + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(half_dlon) * F.sin(half_dlon))
    return F.lit(2 * EARTH_RADIUS_KM) * F.atan2(F.sqrt(chord), F.sqrt(F.lit(1.0) - chord))


def mercator_x(lon: Column) -> Column:
    return F.lit(MERCATOR_RADIUS_M) * F.radians(lon)


def mercator_y(lat: Column) -> Column:
    return F.lit(MERCATOR_RADIUS_M) * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))


def point_segment_square(px: Column, py: Column, x1: Column, y1: Column,
                         x2: Column, y2: Column) -> Column:
    """Squared planar distance from a point to a closed segment (a zero-length one is a point)."""
    dx, dy = x2 - x1, y2 - y1
    length2 = dx * dx + dy * dy
    along = F.when(length2 > 0, ((px - x1) * dx + (py - y1) * dy) / length2).otherwise(F.lit(0.0))
    along = F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0))
    ex, ey = px - (x1 + along * dx), py - (y1 + along * dy)
    return ex * ex + ey * ey


def point_segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt(point_segment_square(px, py, x1, y1, x2, y2))


def _turn(ax, ay, bx, by, cx, cy):
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def segments_cross(a: tuple, b: tuple) -> Column:
    """Proper crossing of two segments, each given as (x1, y1, x2, y2) columns.

    Touching and collinear cases have an end point at distance zero, which
    ``segment_distance`` covers.
    """
    ax1, ay1, ax2, ay2 = a
    bx1, by1, bx2, by2 = b
    return ((_turn(ax1, ay1, ax2, ay2, bx1, by1) * _turn(ax1, ay1, ax2, ay2, bx2, by2) < 0)
            & (_turn(bx1, by1, bx2, by2, ax1, ay1) * _turn(bx1, by1, bx2, by2, ax2, ay2) < 0))


def segment_distance(a: tuple, b: tuple) -> Column:
    ax1, ay1, ax2, ay2 = a
    bx1, by1, bx2, by2 = b
    nearest = F.least(
        point_segment_distance(ax1, ay1, *b), point_segment_distance(ax2, ay2, *b),
        point_segment_distance(bx1, by1, *a), point_segment_distance(bx2, by2, *a))
    return F.when(segments_cross(a, b), F.lit(0.0)).otherwise(nearest)


def ray_crosses(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Half-open crossing test of the eastward ray from the point with one edge."""
    straddles = (y1 > py) != (y2 > py)
    at = (x2 - x1) * (py - y1) / F.when(y2 != y1, y2 - y1) + x1
    return F.coalesce(straddles & (px < at), F.lit(False))
