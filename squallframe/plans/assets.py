"""Asset layer: national totals spread over cells by light and population."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import nonnegative
from ..operators.panel import dense_panel, fill_panel, indicator_rows, wide_to_long
from ..operators.raster import disaggregate, zone_sums
from ..operators.stats import conservation


def national_totals(wide: DataFrame, lookup: DataFrame, indicator: str, first: int, last: int) -> DataFrame:
    """Totals per country id and year on the full panel, missing ones zero and flagged."""
    rows = indicator_rows(wide, indicator)
    long = wide_to_long(rows, ["iso3"], range(first, last + 1))
    panel = dense_panel(lookup.select("country_id", F.upper(F.trim("iso3_final")).alias("iso3")), first, last)
    return fill_panel(panel, long.withColumn("iso3", F.upper("iso3")), ["iso3", "year"], "gdp")


def light_population_weight(light: Column, population: Column, m: float = 1.0, n: float = 1.0) -> Column:
    """light^m x population^n on sanitised values; missing cells weigh nothing."""
    return F.pow(nonnegative(light), F.lit(m)) * F.pow(nonnegative(population), F.lit(n))


def _stacked_years(light: DataFrame, population: DataFrame, zones: DataFrame) -> DataFrame:
    """Light (value) with the population of the same cell and year and the zone of the cell, NULL where there is none."""
    def by_cell(layer: DataFrame, name: str) -> DataFrame:
        return layer.groupBy("row", "col").agg(F.collect_list(F.struct("year", "value")).alias(name))

    cells = by_cell(light, "__light").join(by_cell(population, "__people"), ["row", "col"], "left").join(zones, ["row", "col"], "left")
    years = cells.select("row", "col", "zone", "__people", F.explode("__light").alias("__l"))
    same_year = F.filter("__people", lambda p: p["year"] == F.col("__l.year"))
    return years.select("row", "col", "zone", "__l.year", "__l.value", F.explode_outer(same_year).alias("__p")).select(
        "year", "row", "col", "value", F.col("__p.value").alias("population"), "zone")


def asset_layer(light: DataFrame, population: DataFrame, zones: DataFrame, totals: DataFrame,
                row_offset: int = 0, m: float = 1.0, n: float = 1.0) -> DataFrame:
    """Assets per (year, row, col). Layers hold (year, row, col, value); zones (row, col, value).

    The years of a cell travel together: layers and zones meet in one shuffle by cell, and none by year.
    """
    stacked = _stacked_years(light.withColumn("row", F.col("row") + row_offset), population,
                             zones.select("row", "col", F.col("value").alias("zone")))
    weight = light_population_weight(F.col("value"), F.col("population"), m, n)
    known = totals.filter("is_missing = 0").select("year", F.col("country_id").alias("zone"), "gdp")
    return disaggregate(stacked, known, weight, "gdp", "zone", ["year"])


def asset_conservation(layer: DataFrame, totals: DataFrame) -> DataFrame:
    """Country sums of the layer against the national totals put in."""
    sums = zone_sums(layer, F.col("asset"), "zone", ["year"], "realised")
    target = totals.filter("is_missing = 0 and gdp > 0").select("year", F.col("country_id").alias("zone"), "gdp")
    return conservation(target, sums, "gdp", "realised", ["year", "zone"])
