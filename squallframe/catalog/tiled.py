"""The layer queries J5, J20 and A1 to A3 once more, from blocked array tables; results equal those from cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tiles
from ..sources.sinks import write_tiles
from . import aggregates, joins  # noqa: F401  their SQL is stated there
from . import frames as fr
from .base import SQL, big, query, rounded, scratch_table

#: Tiles of the given grid, which is 64 cells wide.
TILING = tiles.Tiling(32, 16)


def stored_layer(t, name: str, cells, values, origin=(0, 0)):
    """The cells as a table of tiles in the warehouse, bucketed by tile."""
    buckets = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    packed = tiles.to_tiles(cells, values, TILING, origin=origin, buckets=buckets)
    return write_tiles(packed, scratch_table(t, f"tiles_{name}"), buckets)


def _value(cut, digits=6):
    return cut.select("event_id", big("wi").alias("wi"), big("wj").alias("wj"), rounded("value", digits).alias("value"))


@query("j5_tile_window", SQL["j5_window_extract"])
def _(t):
    layer = stored_layer(t, "j5", fr.grid(t).select("row", "col", "value"), ["value"])
    return _value(tiles.tile_windows(fr.anchors(t), layer, TILING, size=5, factor=4), 4)


@query("j20_tile_stack", SQL["j20_layer_stack"])
def _(t):
    g = fr.grid(t)
    base = stored_layer(t, "j20_base", g.select("row", "col", "value"), ["value"], origin=(18, 0))
    others = stored_layer(t, "j20_others", g.select("row", "col", F.col("value").alias("pop"), "zone"), ["pop", "zone"])
    cells = tiles.from_tiles(tiles.stack_tiles(base, {"pop": others}), ["value", "pop", "zone"], TILING)
    return cells.filter("value is not null").select("row", "col", rounded("value").alias("value"), rounded("pop").alias("pop"), "zone")


@query("a1_tile_mean", SQL["a1_block_mean"])
def _(t):
    layer = stored_layer(t, "a1", fr.grid(t).select("row", "col", "value"), ["value"])
    return _value(tiles.tile_windows(fr.anchors(t), layer, TILING, method="mean", size=3, factor=4).filter("value is not null"))


@query("a2_tile_share", SQL["a2_zone_share"])
def _(t):
    layer = stored_layer(t, "a2", fr.grid(t).select("row", "col", "zone"), ["zone"])
    anchors = fr.anchors(t).withColumn("target", F.col("event_id") % 10)
    cut = tiles.tile_windows(anchors, layer, TILING, "zone", size=3, factor=4, target="target").filter("share > 0")
    return cut.select("event_id", big("wi").alias("wi"), big("wj").alias("wj"), rounded("share").alias("share"))


@query("a3_tile_sum", SQL["a3_zone_weighted_sum"])
def _(t):
    g = fr.grid(t)
    light = stored_layer(t, "a3_light", g.select("row", "col", "value"), ["value"])
    zones = stored_layer(t, "a3_zones", g.select("row", "col", "zone", F.abs("signed").alias("people")), ["zone", "people"])
    both = tiles.stack_tiles(light, {"zones": zones})
    weighted = both.withColumn("weight", F.zip_with("value", "people", lambda v, p: v * p))
    return tiles.zone_sums(weighted, "weight").select("zone", rounded("total", 4).alias("total"))
