"""Conservative allocation of a record's loss over window cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .keyed import join_keys


def cell_weights(cells: DataFrame, mask: Column, hazard: Column, asset: Column,
                 same_day: Column | None = None, out: str = "p") -> DataFrame:
    """mask x hazard x asset; the hazard of a day is shared by the storm's steps on that day."""
    per_step = hazard if same_day is None else hazard / same_day
    value = (F.greatest(F.coalesce(mask.cast("double"), F.lit(0.0)), F.lit(0.0))
             * F.greatest(F.coalesce(per_step.cast("double"), F.lit(0.0)), F.lit(0.0))
             * F.greatest(F.coalesce(asset.cast("double"), F.lit(0.0)), F.lit(0.0)))
    return cells.withColumn(out, value)


def _exact_sum(value: Column, scale: int | None) -> Column:
    if scale is None:
        return F.sum(value)
    return F.sum(value.cast(f"decimal(28,{scale})")).cast("double")


def weight_totals(cells: DataFrame, record: str, weight: str = "p", scale: int | None = None, count: str | None = None) -> DataFrame:
    """Weight sum and cell count per record. ``scale`` sums in decimals, independent of order; ``count`` names the number
    of cells a row stands for."""
    n = F.count(F.lit(1)) if count is None else F.sum(count)
    return cells.groupBy(record).agg(_exact_sum(F.col(weight), scale).alias("sum_weight"), n.alias("n_cells"))


def allocate(records: DataFrame, cells: DataFrame, record: str, loss: str, weight: str = "p",
             scale: int | None = None, totals: DataFrame | None = None) -> DataFrame:
    """Cells with their share of the record's loss. Records that allocate nothing have no rows."""
    totals = weight_totals(cells, record, weight, scale) if totals is None else totals
    payable = (records.filter(F.col(loss).isNotNull()).select(record, loss)
               .join(totals, record).filter(F.col("sum_weight") > 0))
    return (cells.join(payable, record)
            .withColumn("share", F.col(weight) / F.col("sum_weight"))
            .withColumn("allocated_usd", F.col(loss) * F.col("share")))


def allocation_summary(records: DataFrame, cells: DataFrame, record: str, loss: str, weight: str = "p",
                       scale: int | None = None, matched: Column | None = None, count: str | None = None) -> DataFrame:
    """One row per record with status and conservation error.

    A row of ``cells`` may stand for several cells, by their summed weight and their number ``count``.

    ``matched`` says whether a record found storms and a place; a matched record whose cells weigh nothing, also
    one without any cell in its days, is ``zero_weight``. Without it a record is matched if it has cells.
    """
    totals = weight_totals(cells, record, weight, scale, count)
    allocated = (allocate(records, cells, record, loss, weight, scale, totals)
                 .groupBy(record).agg(F.sum("allocated_usd").alias("allocated_usd")))
    joined = records.join(totals, record, "left").join(allocated, record, "left")
    found = F.col("n_cells").isNotNull() if matched is None else F.coalesce(matched, F.lit(False))
    status = (F.when(F.col(loss).isNull(), "missing_loss").when(~found, "unmatched")
              .when(F.coalesce("sum_weight", F.lit(0.0)) <= 0, "zero_weight").otherwise("allocated"))
    paid = F.when(F.col("status") == "allocated", F.col("allocated_usd")).otherwise(F.lit(0.0))
    error = (F.when(F.col("status") == "missing_loss", F.lit(None).cast("double"))
             .when(F.col("status") != "allocated", F.lit(1.0))
             .otherwise(F.abs(F.col(loss) - F.col("allocated_usd")) / F.greatest(F.col(loss), F.lit(1.0))))
    return (joined.withColumn("status", status).withColumn("allocated_usd", paid)
            .withColumn("conservation_error", error)
            .withColumn("sum_weight", F.coalesce("sum_weight", F.lit(0.0)))
            .withColumn("n_cells", F.coalesce("n_cells", F.lit(0))))


def accumulate_cells(allocated: DataFrame, cell: Sequence[str], weight: str = "p",
                     window: DataFrame | None = None) -> DataFrame:
    """Loss, normalised weight and number of records per cell; cells of ``window`` without any
    record are kept with zeros."""
    sums = allocated.groupBy(*cell).agg(
        F.sum("allocated_usd").alias("loss_usd"), F.sum("share").alias("weight_norm"),
        F.count_if(F.col(weight) > 0).alias("match_count"))
    if window is None:
        return sums
    filled = join_keys(window, sums, cell, "left")
    return filled.fillna(0, ["loss_usd", "weight_norm", "match_count"])


def accumulate_steps(paid: DataFrame, cells: DataFrame, step: Sequence[str], cell: Sequence[str], weight: str = "p") -> DataFrame:
    """``accumulate_cells`` of records that share their weighted cells: ``paid`` holds what a record allocates over the cells of
    a step (``allocate`` of their summed weight), ``cells`` the weight of each.

    A cell takes of all records the same part of what its step takes, so records are added up before they meet cells.
    """
    taken = paid.groupBy(*step).agg(F.sum(F.col("allocated_usd") / F.col(weight)).alias("__loss"),
                                    F.sum(F.lit(1.0) / F.col("sum_weight")).alias("__share"), F.count(F.lit(1)).alias("__n"))
    return cells.join(taken, list(step)).groupBy(*cell).agg(
        F.sum(F.col(weight) * F.col("__loss")).alias("loss_usd"), F.sum(F.col(weight) * F.col("__share")).alias("weight_norm"),
        F.sum(F.when(F.col(weight) > 0, F.col("__n")).otherwise(F.lit(0))).alias("match_count"))


def diagnose_zero_weight(records: DataFrame, cells: DataFrame, record: str, mask: str, hazard: str,
                         asset: str, candidates: str | None = None) -> DataFrame:
    """First reason why a record with a loss allocates nothing."""
    masked = F.col(mask) > 0
    finite = masked & F.col(hazard).isNotNull() & F.col(asset).isNotNull()
    facts = cells.groupBy(record).agg(
        F.count(F.lit(1)).alias("__cells"), F.count_if(masked).alias("__masked"),
        F.count_if(finite).alias("__finite"), F.max(F.when(finite, F.col(hazard))).alias("__hazard"),
        F.max(F.when(finite, F.col(asset))).alias("__asset"))
    no_groups = F.lit(False) if candidates is None else F.coalesce(F.col(candidates), F.lit(0)) == 0
    label = (F.when(no_groups | F.col("__cells").isNull(), "no_overlap_time_indices")
             .when(F.col("__masked") == 0, "mask_all_zero")
             .when(F.col("__finite") == 0, "all_nonfinite_or_missing")
             .when(F.col("__hazard") <= 0, "hazard_all_zero_under_mask")
             .when(F.col("__asset") <= 0, "litpop_all_zero_under_mask")
             .otherwise("all_nonfinite_or_missing"))
    unavoidable = F.col("diagnosis").isin("mask_all_zero", "litpop_all_zero_under_mask")
    return (records.join(facts, record, "left").withColumn("diagnosis", label)
            .withColumn("avoidable", ~unavoidable)
            .drop("__cells", "__masked", "__finite", "__hazard", "__asset"))
