"""Agreement, drift and coverage statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .keyed import join_keys, with_group_values, with_window_values


def agreement(a: Column, b: Column, min_pairs: int = 3) -> list[Column]:
    """Aggregates comparing two columns over their jointly valid rows."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    n = F.count(x)
    return [
        n.alias("n"), F.avg(x - y).alias("bias"), F.avg(F.abs(x - y)).alias("mae"),
        F.sqrt(F.avg((x - y) * (x - y))).alias("rmse"), F.max(F.abs(x - y)).alias("max_abs"),
        safe_corr(x, y, min_pairs).alias("corr")]


def safe_corr(x: Column, y: Column, min_pairs: int = 3) -> Column:
    """Correlation; NULL for too few pairs or a constant side.

    Written out, because ``corr`` itself divides by zero on a constant side in ANSI mode.
    """
    both = x.isNotNull() & y.isNotNull()
    u, v = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    spread = F.stddev_pop(u) * F.stddev_pop(v)
    enough = (F.count(u) >= min_pairs) & (F.min(u) < F.max(u)) & (F.min(v) < F.max(v)) & (spread > 0)
    return F.when(enough, F.covar_pop(u, v) / spread)


def _series_moments(series: Column) -> tuple[Column, Column]:
    """Mean and population deviation of an array, value by value in its order."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))

    def add(seen: Column, x: Column) -> Column:
        n, off = seen["n"] + 1, x - seen["mean"]
        mean = seen["mean"] + off / n
        return F.struct(n.alias("n"), mean.alias("mean"), (seen["squares"] + (x - mean) * off).alias("squares"))
    seen = F.aggregate(series, start, add)
    total = F.aggregate(series, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(series) > 0, total / F.size(series)), F.when(seen["n"] > 0, F.sqrt(seen["squares"] / seen["n"]))


def sigma_flags(df: DataFrame, keys: Sequence[str], value: str, sigmas: float = 3.0,
                upper_only: bool = False, order: str | None = None) -> DataFrame:
    """Distance of each value from its group's mean in standard deviations, flagged beyond
    ``sigmas``; a group without spread never flags.

    With ``order`` a group, whose size the model bounds (the years of a cell), is added up in that order and its distances are
    the same in every run. Without it they are rounded to 12 decimals: the order in which a group was added up shows beyond them.
    """
    if order is None:
        spread = with_group_values(df, keys, __mean=F.avg(value), __std=F.stddev_pop(value))
    else:
        known = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("at"), F.col(value).cast("double").alias("v")))
        rows = with_window_values(df, keys, __rows=F.collect_list(known))
        mean, std = _series_moments(F.transform(F.array_sort("__rows"), lambda r: r["v"]))
        spread = rows.withColumns({"__mean": mean, "__std": std}).drop("__rows")
    away = (F.col(value) - F.col("__mean")) / F.col("__std")
    z = F.when(F.col("__std") > 0, F.round(away, 12) if order is None else away).otherwise(F.lit(0.0))
    beyond = z > sigmas if upper_only else F.abs(z) > sigmas
    return (spread.withColumn("z_score", z)
            .withColumn("flagged", F.coalesce(beyond, F.lit(False)).cast("int")).drop("__mean", "__std"))


def fill_ratio(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Share of missing cells per key and variable."""
    wide = df.groupBy(*keys).agg(*[F.avg(F.col(v).isNull().cast("double")).alias(v) for v in values])
    return wide.unpivot(list(keys), list(values), "variable", "fill_ratio")


def coverage(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Matched and missing rows of a full panel."""
    matched = F.count(value)
    total = F.count(F.lit(1))
    return df.groupBy(*keys).agg(total.alias("n_total"), matched.alias("n_matched"),
                                 (total - matched).alias("n_missing"), (matched / total).alias("match_rate"))


def line_fit(x: Column, y: Column) -> list[Column]:
    """Least-squares line as aggregates; NULL when all x are equal."""
    both = x.isNotNull() & y.isNotNull()
    u, v = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    spread = F.var_pop(u)
    slope = F.when(spread > 0, F.covar_pop(u, v) / spread)
    return [slope.alias("slope"), (F.avg(v) - slope * F.avg(u)).alias("intercept"), F.count(u).alias("n")]


def top_share_masks(cells: DataFrame, keys: Sequence[str], a: str, b: str, q: float = 0.1,
                    paired: bool = True) -> DataFrame:
    """Cells at or above each side's (1 - q) quantile inside one window.

    ``paired`` takes both thresholds over jointly valid cells only. A window has at most 41 x 41
    cells, so they are ranked in one task. A threshold is the lower of its two neighbours plus its part of the way to the
    upper one, so it never leaves them, not even by the last bit of values that almost tie.
    """
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    use = {c: F.when(both, F.col(c)) if paired else F.col(c) for c in (a, b)}
    group = Window.partitionBy(*keys)
    sides = (("a", use[a]), ("b", use[b]))
    masked = cells
    for s, value in sides:
        masked = masked.withColumn(f"__r{s}", F.row_number().over(group.orderBy(value.asc_nulls_last())))
    masked = with_window_values(masked, keys, **{f"__n{s}": F.count(value) for s, value in sides})
    at = {s: F.lit(1.0 - q) * (F.col(f"__n{s}") - 1) for s, _ in sides}
    masked = with_window_values(masked, keys, **{
        f"__{name}{s}": F.max(F.when(F.col(f"__r{s}") == neighbour(at[s]) + 1, value))
        for s, value in sides for name, neighbour in (("low", F.floor), ("high", F.ceil))})
    for s, value in sides:
        low, high = F.col(f"__low{s}"), F.col(f"__high{s}")
        masked = masked.withColumn(f"top_{s}", F.coalesce(value >= low + (high - low) * (at[s] - F.floor(at[s])), F.lit(False)))
    return masked.drop(*[f"__{name}{s}" for s, _ in sides for name in ("r", "n", "low", "high")])


def mask_overlap(masks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Intersection over union, and recall of side a, of two masks."""
    both, either = F.col("top_a") & F.col("top_b"), F.col("top_a") | F.col("top_b")
    inter = F.count_if(both)
    n_either, n_a = F.count_if(either), F.count_if(F.col("top_a"))
    return masks.groupBy(*keys).agg(inter.alias("n_both"), F.when(n_either > 0, inter / n_either).alias("iou"),
                                    F.when(n_a > 0, inter / n_a).alias("recall"))


def year_transitions(cells: DataFrame, years: Column, value: str, stride: int, keys: Sequence[str] = ()) -> DataFrame:
    """Each year's strided sample beside the following year's, aggregated."""
    sampled = cells.withColumn("year", years)
    if stride > 1:
        sampled = sampled.filter((F.col("row") % stride == 0) & (F.col("col") % stride == 0))
    sampled = sampled.select(*keys, "year", "row", "col", F.col(value).alias("__now"))
    after = sampled.select(*keys, (F.col("year") - 1).alias("year"), "row", "col", F.col("__now").alias("__next"))
    pairs = sampled.join(after, [*keys, "year", "row", "col"])
    mean = F.avg("__now")
    return pairs.groupBy(*keys, "year").agg(
        F.count(F.lit(1)).alias("n"), F.when(mean != 0, F.avg("__next") / mean).alias("mean_ratio"),
        safe_corr(F.col("__now"), F.col("__next")).alias("corr"))


def conservation(zones: DataFrame, realised: DataFrame, target: str, actual: str, keys: Sequence[str],
                 tolerance: float = 1e-6) -> DataFrame:
    """Zone totals of an output layer against the totals put in."""
    joined = join_keys(zones, realised, keys, "left").withColumn(actual, F.coalesce(actual, F.lit(0.0)))
    gap = F.abs(F.col(actual) - F.col(target))
    return (joined.withColumn("abs_error", gap)
            .withColumn("rel_error", F.when(F.col(target) > 0, gap / F.col(target)))
            .withColumn("valid", F.coalesce(F.col("rel_error") <= tolerance, F.col("abs_error") <= tolerance).cast("int")))


def weighted_rate(df: DataFrame, count: str, rate: str) -> DataFrame:
    """Mean of yearly rates weighted by their counts."""
    n = F.when(F.col(rate).isNotNull(), F.col(count))
    return df.agg(F.sum(count).alias("n"), F.when(F.sum(n) > 0, F.sum(n * F.col(rate)) / F.sum(n)).alias("rate"))


def display_limits(limits: Column) -> Column:
    """(low, high) with a usable spread."""
    low, high = limits[0], limits[1]
    return F.when(high > low, F.array(low, high)).otherwise(F.array(low, low + 1.0))
