"""Data-quality levels: inventory, schema, physics, alignment, formulas and attribution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import status as st
from ..functions.hazard import min_max_scaled, wind_power, wind_speed
from .keyed import join_keys, with_window_values
from .quantiles import exact_quantiles
from .stats import agreement, sigma_flags

# Acceptance thresholds.
MAX_CONSERVATION_ERROR = 1e-6
UNMATCHED_YEAR_FAIL = 2
UNMATCHED_RATIO_FAIL = 0.02
AVOIDABLE_RATIO_FAIL = 0.02
REPROJECTION_MAE_FAIL = 1e-5
FORMULA_ERROR_FAIL = 1e-6


def inventory(expected: DataFrame, found: DataFrame, keys: Sequence[str], scope: str) -> DataFrame:
    """Missing items are errors, unexpected ones warnings."""
    item = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
    missing = expected.select(*keys).distinct().join(found.select(*keys).distinct(), list(keys), "left_anti")
    extra = found.select(*keys).distinct().join(expected.select(*keys).distinct(), list(keys), "left_anti")

    def rows(df, level, issue):
        return df.select(F.lit(level).alias("level"), F.lit(scope).alias("scope"), item.alias("item"),
                         F.lit(issue).alias("issue"))
    return rows(missing, "error", "missing").unionByName(rows(extra, "warning", "unexpected"))


def gate(anomalies: DataFrame) -> int:
    """Fail the job when an inventory holds errors; returns the number of warnings."""
    row = anomalies.agg(F.count_if(F.col("level") == "error"), F.count_if(F.col("level") != "error")).first()
    if row[0]:
        raise RuntimeError(f"{row[0]} inventory errors")
    return row[1]


def spec_mismatches(specs: DataFrame, series: str, order: str, exact: Sequence[str],
                    close: dict[str, float]) -> DataFrame:
    """Grid descriptions of a series that differ from its first member."""
    fields = [*exact, *close]
    base = specs.groupBy(series).agg(*[F.min_by(f, order).alias(f"__{f}") for f in fields])
    joined = join_keys(specs, base, [series])
    checks = [F.when(~F.col(f).eqNullSafe(F.col(f"__{f}")), F.lit(f)) for f in exact]
    checks += [F.when(~F.coalesce(F.abs(F.col(f) - F.col(f"__{f}")) <= tol, F.lit(False)), F.lit(f))
               for f, tol in close.items()]
    return (joined.select(series, order, F.explode(F.array_compact(F.array(*checks))).alias("field")))


def spec_differences(specs: DataFrame, keys: Sequence[str], exact: dict[str, object], close: dict[str, tuple[float, float]]) -> DataFrame:
    """Grid descriptions that differ from the expected grid: ``exact`` values, and (value, tolerance) of ``close`` ones."""
    checks = [F.when(~F.col(f).eqNullSafe(F.lit(v)), F.lit(f)) for f, v in exact.items()]
    checks += [F.when(~F.coalesce(F.abs(F.col(f) - F.lit(v)) <= tol, F.lit(False)), F.lit(f)) for f, (v, tol) in close.items()]
    return specs.select(*keys, F.explode(F.array_compact(F.array(*checks))).alias("field"))


def schema_rows(df: DataFrame, **labels: str) -> DataFrame:
    """A frame's columns and types as rows, for checks across stages."""
    fields = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    rows = df.sparkSession.createDataFrame(fields, "position int, variable string, dtype string")
    return rows.select(*[F.lit(v).alias(k) for k, v in labels.items()], "*")


def required_gaps(present: DataFrame, required: Sequence[str], group: str, variable: str,
                  groups: DataFrame | None = None) -> DataFrame:
    """Required variables a group lacks; ``groups`` names groups that may have none at all."""
    wanted = (present if groups is None else groups).select(group).distinct().withColumn(
        variable, F.explode(F.array(*[F.lit(r) for r in required])))
    return wanted.join(present.select(group, variable).distinct(), [group, variable], "left_anti")


def stage_drift(before: DataFrame, after: DataFrame, keys: Sequence[str], compare: Sequence[str]) -> DataFrame:
    """Keys lost, gained or changed between two stages."""
    b = before.select(*keys, *[F.col(c).alias(f"{c}_before") for c in compare], F.lit(True).alias("__b"))
    a = after.select(*keys, *[F.col(c).alias(f"{c}_after") for c in compare], F.lit(True).alias("__a"))
    both = b.join(a, list(keys), "full_outer")
    changed = F.lit(False)
    for c in compare:
        changed = changed | ~F.col(f"{c}_before").eqNullSafe(F.col(f"{c}_after"))
    issue = (F.when(F.col("__a").isNull(), "missing_in_after").when(F.col("__b").isNull(), "extra_in_after")
             .when(changed, "changed"))
    return both.withColumn("issue", issue).filter(F.col("issue").isNotNull()).drop("__a", "__b")


def status_matrix(issues: DataFrame, year: str, stage: str, stages: Sequence[str], status: str) -> DataFrame:
    """Worst status per year and stage, one column per stage."""
    ranked = issues.groupBy(year).pivot(stage, list(stages)).agg(F.max(st.rank_of(F.col(status))))
    return ranked.select(year, *[st.status_of(F.col(s)).alias(s) for s in stages])


def compare_stages(base: DataFrame, final: DataFrame, keys: Sequence[str], value: str,
                   by: Sequence[str] = ()) -> DataFrame:
    """Agreement of one variable between two stages over the keys they share."""
    pair = base.select(*keys, F.col(value).alias("__base")).join(
        final.select(*keys, F.col(value).alias("__final")), list(keys))
    return pair.groupBy(*by).agg(*agreement(F.col("__final"), F.col("__base")))


def describe(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Moments, missing share and exact quantiles per key."""
    moments = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(F.col(value).isNull().cast("double")).alias("missing_ratio"),
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return join_keys(moments, exact_quantiles(df, keys, value, {"p05": 0.05, "p50": 0.5, "p95": 0.95}), keys, "left")


def drift_status(yearly: DataFrame, variable: str, value: str, sigmas: float = 3.0) -> DataFrame:
    flagged = sigma_flags(yearly, [variable], value, sigmas)
    return flagged.withColumn("status", F.when(F.col("flagged") == 1, "WARN").otherwise("PASS"))


def alignment_check(stored: DataFrame, straight: DataFrame, flipped: DataFrame, sample: Sequence[str],
                    value: str) -> DataFrame:
    """A stored window against the one cut again, in both row orders."""
    cell = [*sample, "wi", "wj"]
    joined = (stored.select(*cell, F.col(value).alias("__s"))
              .join(flipped.select(*cell, F.col(value).alias("__f")), cell, "left")
              .join(straight.select(*cell, F.col(value).alias("__n")), cell, "left"))
    flip_gap, plain_gap = F.col("__f") - F.col("__s"), F.col("__n") - F.col("__s")
    checked = joined.groupBy(*sample).agg(
        F.avg(F.abs(flip_gap)).alias("mae"), F.sqrt(F.avg(flip_gap * flip_gap)).alias("rmse"),
        F.max(F.abs(flip_gap)).alias("max_abs"), F.count(flip_gap).alias("valid_cells"),
        F.avg(F.abs(plain_gap)).alias("mae_unflipped"))
    passed = F.coalesce(F.col("mae") <= F.col("mae_unflipped"), F.lit(False)).cast("int")
    status = F.when(F.col("mae") > REPROJECTION_MAE_FAIL, "FAIL").otherwise("PASS")
    return checked.withColumn("orientation_pass", passed).withColumn("status", status)


def with_missing_rasters(checked: DataFrame, planned: DataFrame, sample: Sequence[str]) -> DataFrame:
    """Every planned (sample, variable, path) of an alignment check: one whose layer had no raster to cut from fails with a note."""
    met = join_keys(planned, checked.withColumn("__there", F.lit(True)), [*sample, "variable"], "left")
    there = F.coalesce("__there", F.lit(False))
    return (met.withColumn("valid_cells", F.coalesce("valid_cells", F.lit(0))).withColumn("orientation_pass", F.coalesce("orientation_pass", F.lit(0)))
            .withColumn("status", F.coalesce("status", F.lit("FAIL")))
            .withColumn("note", F.when(there, F.lit("")).otherwise(F.concat(F.lit("missing_raster:"), "path"))).drop("__there", "path"))


def formula_check(windows: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Stored wind, wind power and compound hazard against their formulas.

    Expects u10, v10, wind, hazard_wind, hazard_rain and hazard_compound.
    """
    ranged = with_window_values(windows, keys, __w0=F.min("hazard_wind"), __w1=F.max("hazard_wind"),
                               __r0=F.min("hazard_rain"), __r1=F.max("hazard_rain"))
    again = {
        "wind": wind_speed(F.col("u10"), F.col("v10")), "hazard_wind": wind_power(F.col("wind")),
        "hazard_compound": min_max_scaled(F.col("hazard_wind"), F.col("__w0"), F.col("__w1")) * 0.5
        + min_max_scaled(F.col("hazard_rain"), F.col("__r0"), F.col("__r1")) * 0.5}
    checks = []
    for name, formula in again.items():
        gap = F.abs(F.col(name) - formula)
        checks += [F.max(gap).alias(f"{name}_max_error"), F.avg(gap).alias(f"{name}_mean_error")]
    out = ranged.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_cells"), *checks,
        F.count_if((F.col("hazard_wind") < 0) | (F.col("hazard_rain") < 0)).alias("n_negative"),
        F.count_if(~F.col("hazard_compound").between(0.0, 1.0)).alias("n_out_of_range"))
    worst = F.greatest(*[F.col(f"{n}_max_error") for n in again])
    return out.withColumn("status", st.from_counts(
        ((worst > FORMULA_ERROR_FAIL) | (F.col("n_negative") > 0) | (F.col("n_out_of_range") > 0)).cast("int"),
        F.lit(0)))


def distributions(audit: DataFrame, column: str, with_loss: Column) -> DataFrame:
    """Counts and shares of a category over all records and over those with a loss."""
    scoped = audit.withColumn("scope", F.explode(F.when(
        with_loss, F.array(F.lit("all_records"), F.lit("with_loss"))).otherwise(F.array(F.lit("all_records")))))
    counted = scoped.groupBy("scope", F.col(column).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("scope"))
    return counted.withColumn("share", F.col("n") / total)


def attribution_by_year(audit: DataFrame, year: str = "year") -> DataFrame:
    """Yearly conservation and match figures with the yearly verdict.

    ``audit``: year, status, loss_usd, conservation_error, avoidable (for zero weights).
    """
    loss = F.coalesce(F.col("loss_usd") > 0, F.lit(False))
    zero = loss & (F.col("status") == "zero_weight")
    paid = F.when(F.col("status") == "allocated", F.col("conservation_error"))
    yearly = audit.groupBy(year).agg(
        F.count_if(F.col("status") == "allocated").alias("allocated_count"),
        F.max(paid).alias("max_error"), F.avg(paid).alias("mean_error"),
        F.count_if(loss).alias("with_loss"),
        F.count_if(loss & (F.col("status") == "unmatched")).alias("unmatched_with_loss"),
        F.count_if(zero & F.col("avoidable")).alias("zero_avoidable"),
        F.count_if(zero & ~F.col("avoidable")).alias("zero_unavoidable"))
    fails = F.array_compact(F.array(
        F.when(F.col("max_error") > MAX_CONSERVATION_ERROR, "max_conservation_error"),
        F.when(F.col("unmatched_with_loss") >= UNMATCHED_YEAR_FAIL, "unmatched_with_loss_count_year")))
    return (yearly.withColumn("fail_reasons", F.array_join(fails, ";"))
            .withColumn("status", st.from_counts(F.size(fails), F.col("zero_unavoidable"))))


def attribution_verdict(yearly: DataFrame) -> DataFrame:
    """One row: the ratios over all years and the verdict of the level."""
    total = F.sum("with_loss")

    def ratio(name):
        return F.when(total > 0, F.sum(name) / total)
    sums = yearly.agg(
        total.alias("with_loss"), ratio("unmatched_with_loss").alias("unmatched_ratio"),
        ratio("zero_avoidable").alias("avoidable_ratio"), ratio("zero_unavoidable").alias("unavoidable_ratio"),
        F.count_if(F.col("status") == "FAIL").alias("failed_years"))
    reasons = F.array_compact(F.array(
        F.when(F.col("failed_years") > 0, "year_level_hard_fail"),
        F.when(F.col("unmatched_ratio") > UNMATCHED_RATIO_FAIL, "unmatched_with_loss_ratio_global"),
        F.when(F.col("avoidable_ratio") > AVOIDABLE_RATIO_FAIL, "zero_weight_avoidable_ratio_global")))
    warn = F.coalesce((F.col("unavoidable_ratio") > 0).cast("int"), F.lit(0))
    return (sums.withColumn("fail_reasons", F.array_join(reasons, ";"))
            .withColumn("status", st.from_counts(F.size(reasons), warn)))


def validate_audit(audit: DataFrame, required: Sequence[str], max_error: float = MAX_CONSERVATION_ERROR) -> DataFrame:
    """Column check on the plan, then counts per status with the rows over the error limit."""
    missing = [c for c in required if c not in audit.columns]
    if missing:
        raise ValueError(f"missing audit columns: {missing}")
    over = (F.col("status") == "allocated") & (F.col("conservation_error") > max_error)
    return audit.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if(over).alias("n_over_limit"),
                                       F.max("conservation_error").alias("max_error"))


def golden_check(actual: DataFrame, expected: DataFrame, name: str = "metric", value: str = "value",
                 tolerance: str = "tolerance") -> DataFrame:
    """Published figures against computed ones; an absent figure fails."""
    e = expected.select(name, F.col(value).alias("expected"), tolerance)
    joined = e.join(actual.select(name, F.col(value).alias("actual")), name, "left")
    ok = F.coalesce(F.abs(F.col("actual") - F.col("expected")) <= F.col(tolerance), F.lit(False))
    return joined.withColumn("passed", ok.cast("int"))


def denominator_table(weights: DataFrame, totals: DataFrame, lookup: DataFrame, zone: str = "zone", year: str = "year", name: str = "iso3") -> DataFrame:
    """Every zone and year of ``weights`` (zone, year, denominator) beside its total: what is missing, and what has a total to spread but nowhere to put it."""
    met = weights.join(totals.select(zone, year, "total"), [zone, year], "left").join(lookup.select(zone, name), zone, "left")
    den, total = F.coalesce("denominator", F.lit(0.0)), F.coalesce("total", F.lit(0.0))
    return met.select(zone, name, year, den.alias("denominator"), total.alias("total"), F.col("total").isNull().cast("int").alias("is_missing"),
                      ((den <= 0) & (total > 0)).alias("positive_with_zero_denominator"))


def denominator_logs(table: DataFrame) -> DataFrame:
    """The rows of a denominator table that a report lists, with the name of their log."""
    names = F.array_compact(F.array(F.when(F.col("positive_with_zero_denominator"), "zero_denominator"), F.when(F.col("is_missing") == 1, "missing_total")))
    return table.withColumn("log", F.explode(names))


def qa_summary(table: DataFrame, spread: str, year: str = "year") -> DataFrame:
    """One row over a denominator table: how far the yearly sums of ``spread`` fall short of the totals, and what the logs hold."""
    yearly = table.groupBy(year).agg(F.sum(spread).alias("__s"), F.sum("total").alias("__g"), F.sum("is_missing").alias("__m"),
                                     F.count_if("positive_with_zero_denominator").alias("__z"))
    error = F.abs(F.col("__s") - F.col("__g")) / F.nullif(F.col("__g"), F.lit(0.0))
    return yearly.agg(F.min(year).alias("first_year"), F.max(year).alias("last_year"), F.avg(error).alias("mean_total_rel_error"),
                      F.max(error).alias("max_total_rel_error"), F.sum("__m").alias("missing_count"), F.sum("__z").alias("zero_denominator_count"))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str = "path",
                  compare: Sequence[str] = ("length", "digest")) -> DataFrame:
    """Files that appeared, vanished or changed between two listings."""
    return stage_drift(before, after, [key], compare)


def sampled_digest(length: Column, content: Column, part: int = 1 << 20) -> Column:
    """Digest over a file's size and its first MiB, its middle one if it is longer than two, its last one if longer than one."""
    none = F.lit("").cast("binary")
    half = (F.floor(length / 2) - part // 2).cast("int")
    middle = F.when(length > 2 * part, F.substring(content, half + 1, F.lit(part))).otherwise(none)
    tail = F.when(length > part, F.substring(content, (length - part + 1).cast("int"), F.lit(part))).otherwise(none)
    return F.sha2(F.concat(length.cast("string").cast("binary"), F.substring(content, 1, part), middle, tail), 256)
