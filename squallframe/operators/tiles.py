"""Layers as blocked array tables: one row for each tile, its cells in one array.

A tile is ``rows`` x ``cols`` cells, row by row, NULL where a cell is missing. All layers count their rows and columns
from one common origin, so equal tile keys mean equal places. Tiles are kept in tables bucketed by
their keys (``sources.sinks.write_tiles``): layers are stacked bucket by bucket without moving a cell, and windows
send their anchors to the tiles instead of the tiles to the anchors.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import BLOCK_FACTOR, WINDOW_SIZE

# The tile function travels with the plan, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TILE_KEYS = ("tile_row", "tile_col")
#: Anchors one row of a tile's list holds: bounds the windows that are in memory at a time.
ANCHORS = 256


@dataclass(frozen=True)
class Tiling:
    """Size of a tile in cells."""

    rows: int = 256
    cols: int = 1024

    @property
    def cells(self) -> int:
        return self.rows * self.cols

    def keys(self, row: Column, col: Column) -> tuple[Column, Column]:
        return F.floor(row / self.rows), F.floor(col / self.cols)


def to_tiles(cells: DataFrame, values: Sequence[str], tiling: Tiling, by: Sequence[str] = (),
             origin: tuple[int, int] = (0, 0), buckets: int | None = None) -> DataFrame:
    """Cells as tiles, an array for each value; ``origin`` is where the layer's first cell lies on the common grid.

    One shuffle by tile, each bounded by its size; into ``buckets`` parts for a bucketed table. A cell given twice fails the job.
    """
    row, col = F.col("row") + origin[0], F.col("col") + origin[1]
    tile_row, tile_col = tiling.keys(row, col)
    at = F.pmod(row, F.lit(tiling.rows)) * tiling.cols + F.pmod(col, F.lit(tiling.cols))
    placed = cells.select(*by, tile_row.alias("tile_row"), tile_col.alias("tile_col"), F.struct(at.cast("int").alias("at"), *values).alias("__c"))
    if buckets:
        placed = placed.repartition(buckets, *by, *TILE_KEYS)
    listed = placed.groupBy(*by, *TILE_KEYS).agg(F.array_sort(F.collect_list("__c")).alias("__cells"))

    def filled(name: str) -> Column:
        nulls = F.array(F.lit(None).cast(cells.schema[name].dataType))

        def gap(n: Column) -> Column:
            return F.flatten(F.array_repeat(nulls, n))

        def one(cell: Column, i: Column) -> Column:
            before = F.when(i == 0, F.lit(-1)).otherwise(F.col("__cells")[F.greatest(i - 1, F.lit(0))]["at"])
            return F.concat(gap(cell["at"] - before - 1), F.array(cell[name]))
        whole = F.concat(F.flatten(F.transform("__cells", one)), gap(F.lit(tiling.cells - 1) - F.element_at("__cells", -1)["at"]))
        twice = F.raise_error(F.lit("a tile has a cell twice")).cast(f"array<{cells.schema[name].dataType.simpleString()}>")
        return F.when(F.size(whole) == tiling.cells, whole).otherwise(twice)

    return listed.select(*by, *TILE_KEYS, *[filled(v).alias(v) for v in values])


def _beside(df: DataFrame, values: Sequence[str]) -> Column:
    """Cells of several layers side by side; a layer without this tile gives NULL."""
    return F.arrays_zip(*[F.coalesce(v, F.array().cast(df.schema[v].dataType)).alias(v) for v in values])


def from_tiles(tiles: DataFrame, values: Sequence[str], tiling: Tiling, by: Sequence[str] = ()) -> DataFrame:
    """Tiles as cells; cells that are missing in all of the values are left out."""
    cells = tiles.select(*by, *TILE_KEYS, F.posexplode(_beside(tiles, values)).alias("__at", "__v"))
    row = F.col("tile_row") * tiling.rows + F.floor(F.col("__at") / tiling.cols)
    col = F.col("tile_col") * tiling.cols + F.pmod("__at", F.lit(tiling.cols))
    return (cells.select(*by, row.alias("row"), col.alias("col"), *[F.col("__v")[v].alias(v) for v in values])
            .filter(F.coalesce(*[F.col(v).cast("string") for v in values]).isNotNull()))


def stack_tiles(base: DataFrame, others: dict[str, DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """Tiles of a base layer beside the tiles of aligned layers; a layer without a tile has NULL there.

    Tile arrays are never broadcast (merge hint): tables bucketed by tile are joined where they lie.
    """
    keys = [*by, *TILE_KEYS]
    out = base
    for name, layer in others.items():
        out = out.join(layer.withColumnRenamed("value", name).hint("merge"), keys, "left")
    return out


def zone_sums(stack: DataFrame, weight: str, zone: str = "zone", by: Sequence[str] = (), out: str = "total") -> DataFrame:
    """Sum of a layer per zone, from stacked tiles: a tile adds up its own cells before anything is shuffled."""
    cells = stack.select(*by, F.explode(_beside(stack, [zone, weight])).alias("__c")).select(*by, F.col("__c")[zone].alias(zone), F.col("__c")[weight].alias("__w"))
    return cells.filter(F.col(zone) > 0).groupBy(*by, zone).agg(F.sum("__w").alias(out))


def _touched(anchors: DataFrame, tiling: Tiling, span: int) -> DataFrame:
    """An anchor for each tile its window of ``span`` x ``span`` cells touches."""
    def met(centre: str, size: int) -> Column:
        first = F.col(centre) - span // 2
        return F.explode(F.sequence(F.floor(first / size), F.floor((first + span - 1) / size)))
    return anchors.withColumn("tile_row", met("row", tiling.rows)).withColumn("tile_col", met("col", tiling.cols))


def _block_parts(values: np.ndarray, top: int, left: int, size: int, factor: int, target=None) -> tuple[np.ndarray, np.ndarray]:
    """Sums and valid counts of the blocks of a window whose top-left cell stands at (top, left) of a tile.

    Cells outside the tile count nothing. With ``target`` the sum counts the cells of that value.
    """
    span, (height, width) = size * factor, values.shape
    sums, counts = np.zeros((size, size)), np.zeros((size, size), dtype=np.int64)
    r0, r1, c0, c1 = max(top, 0), min(top + span, height), max(left, 0), min(left + span, width)
    if r0 >= r1 or c0 >= c1:
        return sums, counts
    cut = values[r0:r1, c0:c1]
    valid = ~np.isnan(cut)
    cut = np.where(valid, cut, 0.0) if target is None else (cut == target).astype(float)
    first_row, first_col = (r0 - top) // factor, (c0 - left) // factor
    starts = [np.maximum(np.arange(first, (end - start - 1) // factor + 1) * factor - (low - start), 0)
              for first, start, low, end in ((first_row, top, r0, r1), (first_col, left, c0, c1))]
    for out, data in ((sums, cut), (counts, valid)):
        part = np.add.reduceat(np.add.reduceat(data.astype(out.dtype), starts[0], axis=0), starts[1], axis=1)
        out[first_row:first_row + part.shape[0], first_col:first_col + part.shape[1]] = part
    return sums, counts


def tile_windows(anchors: DataFrame, tiles: DataFrame, tiling: Tiling, value: str = "value", method: str = "sum", by: Sequence[str] = (),
                 size: int = WINDOW_SIZE, factor: int = BLOCK_FACTOR, flip: bool = True, target: str | None = None) -> DataFrame:
    """Windows of block sums, valid-cell means or shares of a target zone, cut from tiles: every column of ``anchors`` but row and col, wi, wj, ``value``.

    Distinct (row, col) anchors are gathered per tile, ``ANCHORS`` to a row, and sent to it; a tile yields one small array for each of
    its anchors, and the few tiles a window touches are added up. Blocks without a valid cell are NULL, shares 0.
    """
    half, slots = size * factor // 2, size * size
    place = [*by, "row", "col", *([target] if target else [])]
    distinct = anchors.select(*place).distinct()
    numbered = _touched(distinct, tiling, size * factor).withColumn("__slot", F.pmod(F.xxhash64("row", "col"), F.lit(1 << 30)))
    wanted = F.struct("row", "col", (F.col(target) if target else F.lit(0)).cast("double").alias("target"))
    # As many lists as keep each near ANCHORS: their number follows from the anchors of the tile.
    counts = numbered.groupBy(*by, *TILE_KEYS).agg(F.ceil(F.count(F.lit(1)) / ANCHORS).alias("__lists"))
    lists = (numbered.join(counts, [*by, *TILE_KEYS]).groupBy(*by, *TILE_KEYS, F.pmod("__slot", "__lists").alias("__list"))
             .agg(F.collect_list(wanted).alias("__anchors")))
    met = lists.join(tiles.select(*by, *TILE_KEYS, value).hint("merge"), [*by, *TILE_KEYS]).drop("__list")
    kept = [met.schema[c] for c in by]
    parts_schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept],
                              "row long, col long, target double, sums array<double>, counts array<long>"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*by, "row", "col", "target", "sums", "counts"]
        for batch in batches:
            for i in range(batch.num_rows):
                at = {c: batch.column(c)[i] for c in batch.schema.names}
                cells = at[value].values.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(tiling.rows, tiling.cols)
                asked = at["__anchors"].as_py()
                found = [_block_parts(cells, a["row"] - half - at["tile_row"].as_py() * tiling.rows, a["col"] - half - at["tile_col"].as_py() * tiling.cols,
                                      size, factor, a["target"] if target else None) for a in asked]
                ends = pa.array(np.arange(len(asked) + 1, dtype=np.int32) * slots)
                columns = [pa.array([at[c].as_py()] * len(asked), type=batch.schema.field(c).type) for c in by]
                columns += [pa.array([a[c] for a in asked], type=t) for c, t in (("row", pa.int64()), ("col", pa.int64()), ("target", pa.float64()))]
                columns += [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([f[j].ravel() for f in found]))) for j in (0, 1)]
                yield pa.record_batch(columns, names=names)

    def added(column: str, zero: Column) -> Column:  # at most a handful of tiles touch one window
        return F.aggregate(F.collect_list(column), F.array_repeat(zero, slots), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))

    parts = met.mapInArrow(cut, parts_schema)
    if target:
        parts = parts.withColumn("target", F.col("target").cast(anchors.schema[target].dataType)).withColumnRenamed("target", target)
    whole = parts.groupBy(*place).agg(added("sums", F.lit(0.0)).alias("__s"), added("counts", F.lit(0).cast("long")).alias("__n"))
    empty = F.array_repeat(F.lit(None).cast("double"), slots)
    blocks = whole.select(*place, F.zip_with("__s", "__n", {
        "sum": lambda s, n: F.when(n > 0, s), "mean": lambda s, n: F.when(n > 0, s / n),
        "share": lambda s, n: s / F.lit(float(factor * factor))}["share" if target else method]).alias("__blocks"))
    missing = F.array_repeat(F.lit(0.0), slots) if target else empty
    out = (anchors.join(blocks, place, "left").withColumn("__blocks", F.coalesce("__blocks", missing))
           .select(*[c for c in anchors.columns if c not in ("row", "col")], F.posexplode("__blocks").alias("__at", value if not target else "share")))
    source_row = F.floor(F.col("__at") / size)
    return (out.withColumn("wi", (F.lit(size - 1) - source_row) if flip else source_row).withColumn("wj", F.pmod("__at", F.lit(size))).drop("__at"))
