"""One missing value inside the engine: NULL. Sentinels exist only at the edges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The file sentinels for missing data.
TRACK_FILL = -999.0
WINDOW_FILL = -9999.0
RAIN_FILL = -9999.9
SENTINELS = (TRACK_FILL, WINDOW_FILL, RAIN_FILL)


def clean(col: Column, sentinels=SENTINELS) -> Column:
    """Sentinels, NaN and infinities become NULL.

    A float32 column holds the sentinel's nearest float32, so that value counts as the sentinel too.
    """
    value = col.cast("double")
    bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    for s in sentinels:
        bad = bad | (value == F.lit(s)) | (value == F.lit(s).cast("float").cast("double"))
    return F.when(~bad, value)


def is_valid(col: Column, sentinels=SENTINELS) -> Column:
    return clean(col, sentinels).isNotNull()


def nonnegative(col: Column, sentinels=SENTINELS) -> Column:
    """Missing, non-finite and negative all become zero."""
    return F.greatest(F.coalesce(clean(col, sentinels), F.lit(0.0)), F.lit(0.0))


def clamp(col: Column, low: float, high: float) -> Column:
    """Clamp valid cells; missing cells stay missing (greatest() alone would drop the NULL)."""
    return F.when(col.isNotNull(), F.least(F.greatest(col, F.lit(low)), F.lit(high)))


def finite_or_zero(col: Column) -> Column:
    return F.coalesce(clean(col, ()), F.lit(0.0))


def with_fill(col: Column, fill: float) -> Column:
    """Sink side: write the sentinel back."""
    return F.coalesce(col.cast("double"), F.lit(fill))


def number(col: Column) -> Column:
    """Text to number; anything unparsable is NULL."""
    return clean(col.try_cast("double"))


def safe_ratio(num: Column, den: Column) -> Column:
    """NULL when the denominator is not positive."""
    return F.when(den > 0, num.cast("double") / den.cast("double"))

