"""Wind, rain and compound hazard columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: wind below this speed (m/s) does no damage.
WIND_THRESHOLD = 12.0


def wind_speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def wind_power(wind: Column, threshold: float = WIND_THRESHOLD) -> Column:
    excess = F.greatest(wind - F.lit(threshold), F.lit(0.0))
    return F.when(wind.isNotNull(), excess * excess * excess)


def rain_mm(metres: Column) -> Column:
    return metres * F.lit(1000.0)


def min_max_scaled(value: Column, low: Column, high: Column) -> Column:
    """0..1 inside one window; constant or empty windows and missing cells give 0."""
    return F.when((high > low) & value.isNotNull(), (value - low) / (high - low)).otherwise(F.lit(0.0))


def sigmoid(x: Column, a, b, c, d) -> Column:
    a, b, c, d = (p if isinstance(p, Column) else F.lit(float(p)) for p in (a, b, c, d))
    return a + b / (F.lit(1.0) + F.exp(c * (x - d)))
