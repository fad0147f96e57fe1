"""Storm-centred windows cut from gridded layers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import wrap_180
from ..functions.hazard import min_max_scaled
from .keyed import join_keys, with_window_values

WINDOW_SIZE = 41
BLOCK_FACTOR = 10


def _explode_range(df: DataFrame, name: str, low: Column, high: Column) -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(low, high)))


def window_frame(anchors: DataFrame, size: int = WINDOW_SIZE, factor: int = BLOCK_FACTOR,
                 flip: bool = True) -> DataFrame:
    """Every window position (wi, wj) of every anchor, with the top-left cell of its block.

    Source rows run north to south, window rows south to north: hence ``flip``.
    """
    half = size * factor // 2
    df = _explode_range(anchors, "__bi", F.lit(0), F.lit(size - 1))
    df = _explode_range(df, "wj", F.lit(0), F.lit(size - 1))
    wi = F.lit(size - 1) - F.col("__bi") if flip else F.col("__bi")
    return (df.withColumn("wi", wi)
            .withColumn("block_row", F.col("row") - half + F.col("__bi") * factor)
            .withColumn("block_col", F.col("col") - half + F.col("wj") * factor)
            .drop("__bi", "row", "col"))


def _place_frame(anchors: DataFrame, place: Sequence[str], size: int, factor: int, flip: bool) -> DataFrame:
    """``window_frame`` of the distinct places of the anchors, which keep their row and col."""
    places = anchors.select(*place).distinct().withColumns({"__row": F.col("row"), "__col": F.col("col")})
    return window_frame(places, size, factor, flip).withColumnsRenamed({"__row": "row", "__col": "col"})


def _beside(anchors: DataFrame, cells: DataFrame, place: Sequence[str]) -> DataFrame:
    """Every anchor with each of the window cells of its ``place``.

    Cells are gathered once for a place, so an anchor is sent once and not once for each cell; a place has one window of them.
    """
    rest = [c for c in cells.columns if c not in place]
    gathered = cells.groupBy(*place).agg(F.collect_list(F.struct(*rest)).alias("__cells"))
    kept = [c for c in anchors.columns if c not in ("row", "col")]
    return join_keys(anchors, gathered, place).select(*kept, F.explode("__cells").alias("__cell")).select(*kept, "__cell.*")


def _reduced_blocks(anchors: DataFrame, cells: DataFrame, by: Sequence[str], size: int, factor: int,
                    first: dict[str, Column], then: dict[str, Column], extra: Sequence[str] = ()) -> DataFrame:
    """Aggregates of each distinct block any window needs, in two separable steps.

    Windows of neighbouring steps and storms share blocks, so their number is bounded by the grid and not by
    the number of steps. Cells are reduced along their row first (``first``, per row and block column), and
    these along the columns (``then``), so a cell is repeated 2 * factor times at most instead of
    factor ** 2. A row asks for the one or two column strips it touches: equi-joins, no range join.
    """
    distinct_anchors = anchors.select(*by, "row", "col").distinct()
    blocks = window_frame(distinct_anchors, size, factor).select(*by, "block_row", "block_col").distinct()
    rows = _explode_range(blocks, "row", F.col("block_row"), F.col("block_row") + factor - 1)
    wanted = _explode_range(rows.select(*by, "row", "block_col").distinct(), "__strip", F.floor(F.col("block_col") / factor),
                            F.floor((F.col("block_col") + factor - 1) / factor))
    stripped = cells.withColumn("__strip", F.floor(F.col("col") / factor))
    across = (wanted.join(stripped, [*by, "row", "__strip"])
              .filter(F.col("col").between(F.col("block_col"), F.col("block_col") + factor - 1))
              .groupBy(*by, "row", "block_col", *extra).agg(*[c.alias(n) for n, c in first.items()]))
    return (rows.join(across, [*by, "row", "block_col"])
            .groupBy(*by, "block_row", "block_col", *extra).agg(*[c.alias(n) for n, c in then.items()]))


def extract_windows(anchors: DataFrame, cells: DataFrame, value: str = "value", method: str = "sum",
                    by: Sequence[str] = (), size: int = WINDOW_SIZE, factor: int = BLOCK_FACTOR,
                    flip: bool = True) -> DataFrame:
    """Dense windows of block sums or valid-cell means around each anchor (row, col).

    Cells outside the grid are simply absent; a block without a valid cell is NULL.
    """
    reduce = {"sum": F.sum, "mean": F.sum, "min": F.min, "max": F.max}[method]
    whole = F.sum("__part") / F.sum("__n") if method == "mean" else reduce("__part")
    blocks = _reduced_blocks(anchors, cells.filter(F.col(value).isNotNull()), by, size, factor,
                             {"__part": reduce(value), "__n": F.count(value)}, {value: whole})
    place = [*by, "row", "col"]
    cut = (_place_frame(anchors, place, size, factor, flip)
           .join(blocks, [*by, "block_row", "block_col"], "left").drop("block_row", "block_col"))
    return _beside(anchors, cut, place)


def zone_share_windows(anchors: DataFrame, zones: DataFrame, zone: str = "zone", target: str = "target",
                       by: Sequence[str] = (), size: int = WINDOW_SIZE, factor: int = BLOCK_FACTOR,
                       flip: bool = True, out: str = "share") -> DataFrame:
    """Share of each block's cells that belong to the anchor's target zone."""
    counts = _reduced_blocks(anchors.drop(target), zones.withColumnRenamed(zone, target), by, size, factor,
                             {"__n": F.count(F.lit(1))}, {out: F.sum("__n") / F.lit(float(factor * factor))}, [target])
    place = [*by, "row", "col", target]
    cut = (_place_frame(anchors, place, size, factor, flip)
           .join(counts, [*by, "block_row", "block_col", target], "left")
           .withColumn(out, F.coalesce(out, F.lit(0.0))).drop("block_row", "block_col"))
    return _beside(anchors, cut, place)


def absolute_coordinates(points: DataFrame, offsets: Sequence[float]) -> DataFrame:
    """Latitude and wrapped longitude of every window position of every point."""
    axis = F.array(*[F.lit(float(o)) for o in offsets])
    return (points.select("*", F.posexplode(axis).alias("wi", "__dlat"))
            .select("*", F.posexplode(axis).alias("wj", "__dlon"))
            .withColumn("lat", F.col("center_lat") + F.col("__dlat"))
            .withColumn("lon", wrap_180(F.col("center_lon") + F.col("__dlon")))
            .drop("__dlat", "__dlon"))


def window_offsets(size: int = WINDOW_SIZE, half_width: float = 5.0) -> list[float]:
    return [-half_width + 2 * half_width * i / (size - 1) for i in range(size)]


def nearest_index(lat: Column, lon: Column, res: float = 0.25, rows: int = 721, cols: int = 1440,
                  wrap: bool = False) -> tuple[Column, Column]:
    """Row and column of the nearest global grid node, half to even.

    By default a longitude just under 360 is clipped to the last column; ``wrap`` sends it to 0.
    """
    i = F.rint((F.lit(90.0) - lat) / F.lit(res))
    j = F.rint(F.pmod(lon, F.lit(360.0)) / F.lit(res))
    j = F.pmod(j, F.lit(float(cols))) if wrap else F.least(F.greatest(j, F.lit(0.0)), F.lit(cols - 1.0))
    return F.least(F.greatest(i, F.lit(0.0)), F.lit(rows - 1.0)).cast("long"), j.cast("long")


def nearest_lookup(points: DataFrame, grid: DataFrame, lat: str, lon: str, day: str,
                   clip_to_year: str | None = None, **grid_shape) -> DataFrame:
    """Grid values at the node nearest to each point, on the point's day.

    ``clip_to_year`` names a season column: days outside it fall on its first or last day.
    """
    when = F.col(day)
    if clip_to_year:
        year = F.col(clip_to_year)
        when = F.least(F.greatest(when, F.make_date(year, F.lit(1), F.lit(1))),
                       F.make_date(year, F.lit(12), F.lit(31)))
    i, j = nearest_index(F.col(lat), F.col(lon), **grid_shape)
    keyed = points.withColumn("day", when).withColumn("lat_idx", i).withColumn("lon_idx", j)
    return keyed.join(grid, ["day", "lat_idx", "lon_idx"], "left")


def axis_span(centre: Column, half_width: float, start: float, res: float,
              half_open: bool = False) -> tuple[Column, Column]:
    """First and last index of a regular axis inside [centre - w, centre + w]."""
    low = F.ceil((centre - F.lit(half_width) - F.lit(start)) / F.lit(res))
    top = (centre + F.lit(half_width) - F.lit(start)) / F.lit(res)
    high = F.ceil(top) - 1 if half_open else F.floor(top)
    return low.cast("long"), high.cast("long")


def coordinate_window(points: DataFrame, grid: DataFrame, lat: str, lon: str, half_width: float,
                      lat_axis: tuple[float, float, int], lon_axis: tuple[float, float, int],
                      keys: Sequence[str] = (), size: int | None = None, half_open: bool = False) -> DataFrame:
    """Grid nodes inside a square around each point, packed from the top-left corner.

    ``size`` is the packing width the caller counts on; a square with more nodes fails the job.

    Axes are (start, step, length) of a regular grid keyed by (lat_idx, lon_idx), so the range
    condition becomes index arithmetic. Nodes meet the squares in tiles at least as large as a square: an
    equi-join to which a point is sent for the four tiles it touches at most and not for each of its nodes.
    """
    spans, sides = {}, {}
    for name, centre, (start, res, length) in (("lat", lat, lat_axis), ("lon", lon, lon_axis)):
        low, high = axis_span(F.col(centre), half_width, start, res, half_open)
        spans[name] = F.greatest(low, F.lit(0)), F.least(high, F.lit(length - 1))
        sides[name] = int(2 * half_width / abs(res)) + 2
    df, tiled = points.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()), grid
    for name in ("lat", "lon"):
        low, high = spans[name]
        if size is not None:
            high = F.when(high - low >= size, F.raise_error(F.lit(f"more than {size} {name} nodes in a window")).cast("long")).otherwise(high)
        df = (df.withColumn(f"__{name}0", low).withColumn(f"__{name}1", high)
              .filter(F.col(f"__{name}0") <= F.col(f"__{name}1")))
    for name, side in sides.items():
        df = _explode_range(df, f"__{name}_tile", F.floor(F.col(f"__{name}0") / side), F.floor(F.col(f"__{name}1") / side))
        tiled = tiled.withColumn(f"__{name}_tile", F.floor(F.col(f"{name}_idx") / side))
    found = df.join(tiled, [*keys, "__lat_tile", "__lon_tile"])
    for name in sides:
        found = found.filter(F.col(f"{name}_idx").between(F.col(f"__{name}0"), F.col(f"__{name}1")))
    return found.select(*keys, "lat_idx", "lon_idx", *[c for c in points.columns if c not in keys], (F.col("lat_idx") - F.col("__lat0")).alias("wi"),
                        (F.col("lon_idx") - F.col("__lon0")).alias("wj"), *[c for c in grid.columns if c not in (*keys, "lat_idx", "lon_idx")])


def day_offsets(points: DataFrame, day: str, before: int = 7, after: int = 7,
                out: str = "day") -> DataFrame:
    """One row per day offset around each point's day."""
    offset = F.explode(F.sequence(F.lit(-before), F.lit(after)))
    return points.withColumn("day_offset", offset).withColumn(out, F.date_add(F.col(day), F.col("day_offset")))


def day_offset_values(points: DataFrame, grid: DataFrame, keys: Sequence[str], day: str, value: str = "value",
                      before: int = 7, after: int = 7) -> DataFrame:
    """The grid's value on every day around each point's day, NULL where it has none; a row per ``day_offset``.

    Days meet in blocks of twice the span: a point is sent once and not once for each offset, a grid row for one or two
    blocks, whose values are gathered (a block has a bounded number of days). More than one grid row a day and place fail the job.
    """
    length = 2 * (before + after + 1)
    when = F.unix_date("day")
    near = _explode_range(grid.select(*keys, value, when.alias("__day")), "__block", F.floor((F.col("__day") - after) / length),
                          F.floor((F.col("__day") + before) / length))
    gathered = near.groupBy(*keys, "__block").agg(F.map_from_entries(F.collect_list(F.struct("__day", value))).alias("__values"))
    placed = points.withColumn("__day", F.unix_date(day)).withColumn("__block", F.floor(F.col("__day") / length))
    spread = _explode_range(placed.join(gathered, [*keys, "__block"], "left"), "day_offset", F.lit(-before), F.lit(after))
    found = F.try_element_at("__values", F.col("__day") + F.col("day_offset"))
    return spread.select(*points.columns, "day_offset", found.alias(value))


def packed_year_slots(points: DataFrame, days: DataFrame, day: str, reach: int = 7) -> DataFrame:
    """Earlier slot rule: source days in [t - reach, t + reach) of the point's own year, left-packed."""
    spread = day_offsets(points, day, reach, reach - 1)
    same_year = spread.filter(F.year("day") == F.year(day))
    present = same_year.join(days.select("day").distinct(), "day")
    # All candidate days of one point lie on the same row after this aggregate: at most 14 of them.
    packed = present.groupBy(*points.columns).agg(F.array_sort(F.collect_list("day")).alias("__days"))
    return packed.select(*points.columns, F.posexplode("__days").alias("slot", "day"))


def compound_hazard(windows: DataFrame, wind: str, rain: str, keys: Sequence[str]) -> DataFrame:
    """Half scaled wind power plus half scaled rain, scaled inside each window."""
    ranged = with_window_values(windows, keys, __w0=F.min(wind), __w1=F.max(wind),
                               __r0=F.min(rain), __r1=F.max(rain))
    scaled = (min_max_scaled(F.col(wind), F.col("__w0"), F.col("__w1")) * 0.5
              + min_max_scaled(F.col(rain), F.col("__r0"), F.col("__r1")) * 0.5)
    return ranged.withColumn("hazard_compound", scaled).drop("__w0", "__w1", "__r0", "__r1")


def bilinear_sample(points: DataFrame, grid: DataFrame, lat: str, lon: str,
                    lat_axis: tuple[float, float, int], lon_axis: tuple[float, float, int],
                    keys: Sequence[str], point_id: Sequence[str], values: Sequence[str],
                    nearest: Sequence[str] = ()) -> DataFrame:
    """Bilinear values with wrapped longitude; weights renormalised over the valid corners.

    Count-like fields in ``nearest`` take the closest node instead. The grid is keyed by
    (keys, i_lon, j_lat).
    """
    lat0, dlat, nlat = lat_axis
    lon0, dlon, nlon = lon_axis
    last = lat0 + dlat * (nlat - 1)
    fx = (wrap_180(F.col(lon)) - F.lit(lon0)) / F.lit(dlon)
    fy = (F.least(F.greatest(F.col(lat), F.lit(min(lat0, last))), F.lit(max(lat0, last))) - F.lit(lat0)) / F.lit(dlat)
    placed = (points.withColumn("__fx", fx).withColumn("__fy", fy)
              .withColumn("__i", F.floor("__fx"))
              .withColumn("__j", F.least(F.greatest(F.floor("__fy"), F.lit(0)), F.lit(nlat - 2)))
              .withColumn("__u", F.col("__fx") - F.col("__i"))
              .withColumn("__v", F.col("__fy") - F.col("__j"))
              .withColumn("__ni", F.pmod(F.rint("__fx").cast("long"), F.lit(nlon)))
              .withColumn("__nj", F.least(F.greatest(F.rint("__fy").cast("long"), F.lit(0)), F.lit(nlat - 1))))
    u, v, one = F.col("__u"), F.col("__v"), F.lit(1.0)
    corner = F.explode(F.array(*[
        F.struct(F.lit(di).alias("di"), F.lit(dj).alias("dj"), w.alias("w"))
        for di, dj, w in ((0, 0, (one - u) * (one - v)), (1, 0, u * (one - v)),
                          (0, 1, (one - u) * v), (1, 1, u * v))]))
    corners = (placed.withColumn("__c", corner)
               .withColumn("i_lon", F.pmod(F.col("__i") + F.col("__c.di"), F.lit(nlon)))
               .withColumn("j_lat", F.col("__j") + F.col("__c.dj")))
    found = corners.join(grid, [*keys, "i_lon", "j_lat"], "left")
    weight = F.col("__c.w")
    sums = []
    for name in values:
        ok = F.col(name).isNotNull()
        mass = F.sum(F.when(ok, weight))
        sums.append(F.when(mass > 0, F.sum(F.when(ok, weight * F.col(name))) / mass).alias(name))
    here = (F.col("i_lon") == F.col("__ni")) & (F.col("j_lat") == F.col("__nj"))
    sums += [F.max(F.when(here, F.col(name))).alias(name) for name in nearest]
    return found.groupBy(*point_id).agg(*sums)
