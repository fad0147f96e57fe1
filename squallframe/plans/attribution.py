"""From disaster records and storm windows to allocated losses and audits."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import allocation as al
from ..operators.matching import match_audit, match_records, prepare_records, same_day_steps, storm_lives
from ..operators.spatial import points_in_units, resolve_units
from ..session import reuse


@dataclass(frozen=True)
class Attribution:
    """``cells``: loss per window cell; ``matches`` and ``summary``: one audit row per record."""

    cells: DataFrame
    matches: DataFrame
    summary: DataFrame
    kept: tuple[DataFrame, ...]

    def release(self) -> None:
        """Free the cached tables once the results are written."""
        for frame in self.kept:
            frame.unpersist()


def attribute_losses(records: DataFrame, track_points: DataFrame, windows: DataFrame, units: DataFrame,
                     edges: DataFrame, lookup: DataFrame, shares: DataFrame | None = None,
                     pad_days: int = 1, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> Attribution:
    """Match, mask, weigh and allocate.

    ``keep(frame, name)`` writes a stage table and returns it read back: later stages then plan from files and read each
    stage once. Without it no job is taken, stages are cached at their first use and ``release`` frees them.

    records: disaster records with rec_id. track_points: storm_id, storm_name, step, obs_date.
    windows: storm_id, step, wi, wj, lat, lon, hazard, asset. shares: storm_id, step, wi, wj,
    country_id, share for records located only by country.
    """
    kept: list[DataFrame] = []

    def stage(df: DataFrame, name: str) -> DataFrame:
        if keep is not None:
            return keep(df, name)
        kept.append(reuse(df))
        return kept[-1]

    prepared = stage(prepare_records(records, pad_days), "records")
    storms = storm_lives(track_points, carry=("storm_name",))
    # Matches, units and audit have a row for each record and candidate; they feed several results and are kept.
    matches = stage(match_records(prepared.select("rec_id", "event_name", "pad_start", "pad_end"), storms), "matches")
    sources, found_units = resolve_units(prepared, units, lookup, keep=stage)
    record_units = stage(found_units, "record_units")
    audit = stage(match_audit(prepared, matches, sources), "audit")

    # Records with the same units and country share a mask, and every step is weighed once for each mask.
    payable = audit.filter("status_prealloc = 'matched'").select("rec_id", "pad_start", "pad_end", "country_id")
    placed = record_units.groupBy("rec_id").agg(F.array_sort(F.collect_set("unit_id")).alias("units"))
    chosen = matches.filter("selected").select("rec_id", "storm_id")
    steps = same_day_steps(track_points.select("storm_id", "step", "obs_date"))
    record_steps = stage(payable.join(placed, "rec_id", "left").join(chosen, "rec_id").join(steps, "storm_id")
                         .filter(F.col("obs_date").between(F.col("pad_start"), F.col("pad_end")))
                         .select("rec_id", F.struct("units", "country_id").alias("mask"), "storm_id", "step", "same_day"), "record_steps")
    on = ["mask", "storm_id", "step", "same_day"]
    mask_steps = stage(record_steps.select(*on).distinct(), "mask_steps")
    cells = mask_steps.join(windows, ["storm_id", "step"]).withColumn("country_id", F.col("mask.country_id"))

    # Only cells of matched steps are held against only the outlines that a record names.
    met = windows.join(mask_steps.select("storm_id", "step").distinct(), ["storm_id", "step"], "left_semi")
    named = edges.join(record_units.select("unit_id").distinct(), "unit_id", "left_semi")
    mask_units = mask_steps.select("mask").distinct().select("mask", F.explode("mask.units").alias("unit_id"))
    by_unit = (points_in_units(met, named, "lon", "lat").join(mask_units, "unit_id").select("mask", "lon", "lat").distinct()
               .withColumn("__in", F.lit(1.0)))
    masked = cells.join(by_unit, ["mask", "lon", "lat"], "left")
    if shares is not None:
        masked = masked.join(shares, ["storm_id", "step", "wi", "wj", "country_id"], "left")
    else:
        masked = masked.withColumn("share", F.lit(0.0))
    inside_share = F.coalesce("__in", "share", F.lit(0.0))
    weighted = stage(al.cell_weights(masked, inside_share, F.col("hazard"), F.col("asset"), F.col("same_day"))
                     .select(*on, "wi", "wj", "p").filter("p > 0"), "weights")

    # A record's weight adds up from its steps, and what all records give to a cell of a step from their factors.
    weighed = weighted.groupBy(*on).agg(F.sum("p").alias("p"), F.count(F.lit(1)).alias("cells"))
    record_weights = stage(record_steps.select("rec_id", *on).join(weighed, on), "record_weights")
    losses = audit.withColumn("loss_usd", F.when(F.col("status_prealloc") != "missing_loss", F.col("loss_usd")))
    summary = al.allocation_summary(losses.select("rec_id", "loss_usd", "grade", "source", "selected_storms", "loss_source", "status_prealloc"),
                                    record_weights, "rec_id", "loss_usd", matched=F.col("status_prealloc") == "matched", count="cells")
    paid = al.allocate(losses.select("rec_id", "loss_usd"), record_weights, "rec_id", "loss_usd")
    return Attribution(al.accumulate_steps(paid, weighted, on, ["storm_id", "step", "wi", "wj"]), audit, summary, tuple(kept))
