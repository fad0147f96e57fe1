"""Polygons as edge lists: containment, distance and unit resolution by joins.

``edges`` holds one row per polygon edge (unit_id, x1, y1, x2, y2); a unit's bounding box and
everything else follow from it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.geo import mercator_x, mercator_y, point_segment_square, ray_crosses, segments_cross


def unit_boxes(edges: DataFrame, unit: str = "unit_id") -> DataFrame:
    return edges.groupBy(unit).agg(
        F.min(F.least("x1", "x2")).alias("min_x"), F.min(F.least("y1", "y2")).alias("min_y"),
        F.max(F.greatest("x1", "x2")).alias("max_x"), F.max(F.greatest("y1", "y2")).alias("max_y"))


def boxes_meeting(boxes: DataFrame, min_x, min_y, max_x, max_y) -> DataFrame:
    """Units whose box meets a rectangle; min/max columns prune Parquet row groups."""
    return boxes.filter((F.col("max_x") >= min_x) & (F.col("min_x") <= max_x)
                        & (F.col("max_y") >= min_y) & (F.col("min_y") <= max_y))


class _TileTest:
    """Exact containment tests of tiles and of points in them, by index arithmetic on one tile size.

    A point's parity is that of its tile's south-east corner, plus the crossings between: eastward up to the tile's east side, and
    along that side down to the corner. Both can only be crossed by edges that touch the tile. "East" and
    "above" compare tile numbers where a tile's side is meant, so rounding cannot make two formulas differ.
    """

    def __init__(self, tile: float):
        self.size = F.lit(float(tile))

    def tile(self, value: Column) -> Column:
        return F.floor(value / self.size)

    def span(self, low: Column, high: Column) -> Column:
        return F.explode(F.sequence(self.tile(low), self.tile(high)))

    @staticmethod
    def meets(y: Column) -> Column:
        """Where an edge meets the height ``y``, never beyond its ends."""
        x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
        at = (x2 - x1) * (y - y1) / F.when(y2 != y1, y2 - y1) + x1
        return F.least(F.greatest(at, F.least(x1, x2)), F.greatest(x1, x2))

    def corner_line(self, edges: DataFrame, unit: str) -> DataFrame:
        """(unit, __ty, __tx, n): edges that cross the south side of a row of tiles, by the tile they cross it in."""
        low, high = self.tile(F.least("y1", "y2")), self.tile(F.greatest("y1", "y2"))
        rows = edges.filter(low < high).withColumn("__ty", F.explode(F.sequence(low + 1, high)))
        return (rows.withColumn("__tx", self.tile(self.meets(F.col("__ty") * self.size)))
                .groupBy(unit, "__ty", "__tx").agg(F.count(F.lit(1)).alias("__n")))

    def crossings(self, x: str, y: str) -> Column:
        """Whether an edge of the tile is crossed an odd number of times between a point and its tile's corner."""
        px, py, tx, ty = F.col(x), F.col(y), F.col("__tx"), F.col("__ty")
        y1, y2 = F.col("y1"), F.col("y2")
        right1, right2 = self.tile(F.col("x1")) > tx, self.tile(F.col("x2")) > tx
        above1, above2 = self.tile(y1) >= ty, self.tile(y2) >= ty

        def north(of1: Column, of2: Column, at: Column) -> Column:
            """The edge meets the east side's line above the height ``of1`` and ``of2`` refer to."""
            eastward = (of1 != of2) & (self.tile(at) > tx)
            return F.when(right1, of1).otherwise(of2) != F.coalesce(eastward, F.lit(False))
        at = self.meets(py)
        inner = ((y1 > py) != (y2 > py)) & (px < at) & (self.tile(at) <= tx)
        side = (right1 != right2) & (north(y1 > py, y2 > py, at) != north(above1, above2, self.meets(ty * self.size)))
        return F.coalesce(inner, F.lit(False)) != F.coalesce(side, F.lit(False))


def corner_parity(edges: DataFrame, tile: float = 1.0, unit: str = "unit_id") -> DataFrame:
    """Index of outlines: (unit, __tx, __ty, __edge, __odd) of every tile that matters.

    Tiles an edge touches have ``__edge`` and the parity of their south-east corner; the others listed lie wholly inside. Parities are prefix
    sums along a row of tiles, so a unit's row (as many tiles as it is wide) is all that is ever ordered together.
    """
    test = _TileTest(tile)
    spans = (test.span(F.least("x1", "x2"), F.greatest("x1", "x2")), test.span(F.least("y1", "y2"), F.greatest("y1", "y2")))
    touched = edges.select(unit, "x1", "x2", spans[1].alias("__ty")).select(unit, spans[0].alias("__tx"), "__ty", F.lit(0).cast("long").alias("__n"))
    # A crossed tile is a touched one, so one aggregate holds both.
    line = touched.unionByName(test.corner_line(edges, unit)).groupBy(unit, "__ty", "__tx").agg(F.sum("__n").alias("__n"))
    eastward = Window.partitionBy(unit, "__ty").orderBy(F.col("__tx").desc())
    east = F.coalesce(F.sum("__n").over(eastward.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    walked = line.withColumns({"__east": east, "__next": F.lead("__tx").over(eastward)})
    gap = F.when((F.col("__east") + F.col("__n")) % 2 == 1, F.col("__tx") - F.col("__next") - 1)
    inner = F.when(gap > 0, F.transform(F.sequence(F.lit(1).cast("long"), F.when(gap > 0, gap)),
                                        lambda k: F.struct((F.col("__tx") - k).alias("__tx"), F.lit(False).alias("__edge"), F.lit(True).alias("__odd"))))
    own = F.array(F.struct(F.col("__tx"), F.lit(True).alias("__edge"), (F.col("__east") % 2 == 1).alias("__odd")))
    return (walked.select(unit, "__ty", F.explode(F.when(inner.isNotNull(), F.concat(own, inner)).otherwise(own)).alias("__t"))
            .select(unit, "__ty", "__t.*"))


def points_in_units(points: DataFrame, edges: DataFrame, x: str, y: str, tile: float = 1.0,
                    unit: str = "unit_id") -> DataFrame:
    """(x, y, unit) of every distinct point that lies inside a unit, whose edges form closed rings.

    Distinct points only, since windows of many steps repeat the same coordinates. Points in tiles wholly inside a unit follow by an
    equi-join; a point in a tile that an outline touches is held against the edges of that tile alone, however long
    the outline is, and the parity of the tile's corner tells the rest.
    """
    test = _TileTest(tile)
    useful = corner_parity(edges, tile, unit)
    local = (edges.select(unit, "x1", "y1", "x2", "y2", test.span(F.least("y1", "y2"), F.greatest("y1", "y2")).alias("__ty"))
             .withColumn("__tx", test.span(F.least("x1", "x2"), F.greatest("x1", "x2"))))
    distinct = (points.select(x, y).filter(F.col(x).isNotNull() & F.col(y).isNotNull()).distinct()
                .withColumn("__tx", test.tile(F.col(x))).withColumn("__ty", test.tile(F.col(y))))
    placed = distinct.join(useful, ["__tx", "__ty"])
    tested = (placed.filter("__edge").join(local, [unit, "__tx", "__ty"])
              .groupBy(x, y, unit, "__odd").agg(F.count_if(test.crossings(x, y)).alias("__n"))
              .filter((F.col("__n") % 2 == 1) != F.col("__odd")))
    return placed.filter("not __edge").select(x, y, unit).unionByName(tested.select(x, y, unit))


def mask_points(points: DataFrame, record_units: DataFrame, edges: DataFrame, record: str, x: str, y: str,
                tile: float = 1.0, out: str = "inside") -> DataFrame:
    """0/1 mask of a record's points: inside any of the record's units.

    A record's own points name the few units they lie in, and the pairs of record and unit are looked up: points of other records never
    meet a unit only because many records name it.
    """
    inside = points_in_units(points, edges, x, y, tile)
    hit = (points.select(record, x, y).distinct().join(inside, [x, y])
           .join(record_units.select(record, "unit_id").distinct(), [record, "unit_id"]).select(record, x, y).distinct())
    return (points.join(hit.withColumn("__hit", F.lit(1)), [record, x, y], "left")
            .withColumn(out, F.coalesce("__hit", F.lit(0))).drop("__hit"))


def dissolve(edges: DataFrame, unit_key: DataFrame, key: str, unit: str = "unit_id") -> DataFrame:
    """Re-key edges to a coarser unit; parts stay apart and the union is an OR over parts."""
    return edges.join(unit_key.select(unit, key), unit)


GADM_SCHEMA = "array<struct<gid_1:string,gid_2:string>>"
NAME_SCHEMA = "array<struct<adm1_name:string,adm2_name:string>>"


def resolve_units(records: DataFrame, units: DataFrame, lookup: DataFrame, record: str = "rec_id",
                  iso: str = "iso", gadm: str = "gadm_units", admin: str = "admin_units",
                  fold: bool = True, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Where a record's loss may lie: unit ids, then unit names, then a special territory, then
    the whole country, else nowhere. Returns (record, source, spatial_detail, note, country_id) and (record, unit_id).

    ``units``: unit_id, level, gid0, gid, name. ``lookup``: iso3_final, country_id. What a record may be found by (ids of its list
    and of its free text, names, its territory) leaves it in one pass and meets the units in one join. Both results come from the
    units found, which ``keep(frame, name)`` may write as a stage table.
    """
    listed = F.flatten(F.transform(F.coalesce(tx.json_list(F.col(gadm), GADM_SCHEMA), F.array()), lambda s: F.array(s["gid_2"], s["gid_1"])))
    spelled = F.coalesce(tx.gids_in_text(F.col(gadm)), F.array().cast("array<string>"))
    country = F.upper(F.coalesce(iso, F.lit("")))

    def clue(p: float, place: Column, level: Column | int, name: Column) -> Column:
        return F.struct(F.lit(p).alias("p"), place.alias("place"), (F.lit(level) if isinstance(level, int) else level).cast("int").alias("level"), name.alias("name"))
    of_id = lambda p: lambda gid: clue(p, F.upper(F.trim(gid)), 0, F.lit(""))
    of_names = F.flatten(F.transform(F.coalesce(tx.json_list(F.col(admin), NAME_SCHEMA), F.array().cast(NAME_SCHEMA)), lambda s: F.array(
        clue(2.0, country, 2, s["adm2_name"]), clue(2.0, country, 1, s["adm1_name"]))))
    of_territory = F.array(clue(3.0, F.upper(iso), -1, F.lit("")))
    clues = (records.select(record, F.explode(F.concat(F.transform(listed, of_id(1.0)), F.transform(spelled, of_id(1.5)), of_names, of_territory)).alias("__c"))
             .select(record, "__c.*").withColumn("name", tx.normalize(F.col("name"), fold)))
    named = (F.col("level") < 1) | ((F.col("name") != "") & ~F.col("name").contains(tx.NOT_AVAILABLE))
    clues = clues.filter((F.col("place") != "") | (F.col("level") > 0)).filter(named).distinct()

    # Territories that have units of their own under another country.
    fine = units.filter("level in (1, 2)").select("level", "unit_id", "name", F.upper(F.trim("gid")).alias("gid"), F.upper(F.trim("gid0")).alias("gid0"))
    level, gid = F.col("level"), F.col("gid")
    territory = (F.when(((level == 1) & (gid == "CHN.HKG")) | ((level == 2) & gid.startswith("HKG.")), "HKG")
                 .when(((level == 1) & (gid == "CHN.MAC")) | ((level == 2) & gid.startswith("MAC.")), "MAC"))
    key = lambda place, at, name: F.struct(place.alias("place"), at.cast("int").alias("level"), name.alias("name"))
    known = (fine.withColumn("name", tx.normalize(F.col("name"), fold))
             .select("unit_id", F.col("level").alias("own"), F.explode(F.array(
                 key(F.col("gid"), F.lit(0), F.lit("")), key(F.col("gid0"), level, F.col("name")), key(territory, F.lit(-1), F.lit("")))).alias("__k"))
             .select("unit_id", "own", "__k.*").filter(F.col("place").isNotNull()))
    # The few units of two territories count at their coarsest level; the units a record can name are few too.
    coarsest = F.min("own").over(Window.partitionBy("place", "level"))
    known = known.withColumn("__l", F.when(F.col("level") == -1, coarsest)).filter("__l is null or own = __l")
    best = F.min("p").over(Window.partitionBy(record))
    hits = (clues.join(known.select("unit_id", "place", "level", "name"), ["place", "level", "name"]).withColumn("__b", best)
            .filter("p = __b").select(record, F.floor("p").alias("__o"), "unit_id").distinct())
    if keep is not None:
        hits = keep(hits, "unit_hits")
    chosen = hits.groupBy(record).agg(F.max("__o").alias("__o"))
    picked = hits.select(record, "unit_id")
    countries = lookup.select(F.upper(F.trim("iso3_final")).alias("__iso"), "country_id")
    source = (records.select(record, F.upper(F.trim(iso)).alias("__iso")).join(chosen, record, "left")
              .join(countries, "__iso", "left")
              .select(record,
                      F.when(F.col("__o").isin(1, 3), "gadm_gid").when(F.col("__o") == 2, "admin_name")
                      .when(F.col("country_id").isNotNull(), "iso_country").otherwise("none").alias("source"),
                      F.when(F.col("__o") == 1, "GADM Admin Units").when(F.col("__o") == 2, "Admin Units")
                      .when(F.col("__o") == 3, F.concat(F.lit("special_"), "__iso"))
                      .when(F.col("country_id").isNotNull(), F.concat(F.lit("country_id="), F.col("country_id").cast("string")))
                      .otherwise("no_spatial_strategy").alias("spatial_detail"),
                      F.when(F.col("__o").isNull() & F.col("country_id").isNull(),
                             F.concat(F.lit("No spatial strategy for ISO="), F.coalesce("__iso", F.lit("")))).otherwise("").alias("note"),
                      F.when(F.col("__o").isNull(), F.col("country_id")).alias("country_id")))
    return source, picked


def with_fallback(left: DataFrame, pair: DataFrame, single: DataFrame, pair_keys: Sequence[str],
                  single_keys: Sequence[str], value: str) -> DataFrame:
    """Value looked up by the full key, else by the shorter one, with the level that matched."""
    p = pair.select(*pair_keys, F.col(value).alias("__pair"))
    s = single.select(*single_keys, F.col(value).alias("__single"))
    return (left.join(p, list(pair_keys), "left").join(s, list(single_keys), "left")
            .withColumn(value, F.coalesce("__pair", "__single"))
            .withColumn("matched_by", F.when(F.col("__pair").isNotNull(), "pair")
                        .when(F.col("__single").isNotNull(), "single").otherwise("none"))
            .drop("__pair", "__single"))


def project_segments(segments: DataFrame) -> DataFrame:
    """Degrees to Web-Mercator metres."""
    return (segments.withColumn("x1", mercator_x(F.col("x1"))).withColumn("x2", mercator_x(F.col("x2")))
            .withColumn("y1", mercator_y(F.col("y1"))).withColumn("y2", mercator_y(F.col("y2"))))


def track_segments(points: DataFrame, key: str, seq: str, x: str, y: str) -> DataFrame:
    """Consecutive points of a track as segments; a lone point is a zero-length one.

    ``seq`` numbers a track's points from 1, so the next point is an equi-join away.
    """
    here = points.select(key, seq, F.col(x).alias("x1"), F.col(y).alias("y1"))
    after = points.select(key, (F.col(seq) - 1).alias(seq), F.col(x).alias("x2"), F.col(y).alias("y2"))
    lone = (F.col("x2").isNull() & (F.col(seq) == 1)) | F.col("x2").isNotNull()
    return (here.join(after, [key, seq], "left").filter(lone)
            .withColumn("x2", F.coalesce("x2", "x1")).withColumn("y2", F.coalesce("y2", "y1")))


def segment_boxes(segments: DataFrame, key: str, mark: str, cells: tuple[float, float] = (4e6, 2e5)) -> DataFrame:
    """The box table of a side (``mark`` a or b): a row for each key and fine cell with its coarse cell, its box and its segments.

    Dealt by key once. Kept as a table bucketed by key, it serves every step of ``box_distance`` without a shuffle.
    """
    where = {f"c{axis}{mark}{level}": F.floor(F.col(f"{axis}1") / size) for level, size in enumerate(cells) for axis in "xy"}
    ends = segments.select(key, "x1", "y1", "x2", "y2").withColumns(where)
    # With all of them known to be present, every step asks for the same rows and Spark reuses the one shuffle.
    ends = ends.filter(reduce(and_, [F.col(c).isNotNull() for c in ends.columns])).repartition(key)
    return ends.groupBy(key, *where).agg(
        F.min(F.least("x1", "x2")).alias(f"l{mark}"), F.max(F.greatest("x1", "x2")).alias(f"r{mark}"),
        F.min(F.least("y1", "y2")).alias(f"b{mark}"), F.max(F.greatest("y1", "y2")).alias(f"t{mark}"),
        F.collect_list(F.struct(*[F.col(c).alias(c + mark) for c in ("x1", "y1", "x2", "y2")])).alias(f"segs{mark}"))


def set_distance(tracks: DataFrame, outlines: DataFrame, key: str, cells: tuple[float, float] = (4e6, 2e5),
                 out: str = "distance") -> DataFrame:
    """``box_distance`` of segments whose boxes are not kept."""
    return box_distance(segment_boxes(tracks, key, "a", cells), segment_boxes(outlines, key, "b", cells), key, out)


def box_distance(a: DataFrame, b: DataFrame, key: str, out: str = "distance") -> DataFrame:
    """Smallest distance between a connected line (boxes ``a``) and a closed outline (boxes ``b``) per key, as planar segments; 0 when the
    line enters the outline.

    Both sides lie by key, so all that follows is local: boxes of the coarse cells drop the pairs that cannot beat the best
    distance guaranteed so far, boxes of the fine cells below the rest do the same, and what is left names the segments to be
    compared. The same last pass over the outline's boxes counts the edges east of a point of the line, which tells whether it lies
    inside. A key's line and outline are bounded by the model, its coarse cells by the map (about a hundred).
    """
    def upper(fine: DataFrame, mark: str) -> DataFrame:
        return fine.groupBy(key, f"cx{mark}0", f"cy{mark}0").agg(
            *[f(f"{side}{mark}").alias(f"{side}{mark}") for side, f in (("l", F.min), ("r", F.max), ("b", F.min), ("t", F.max))])

    def near(pairs: DataFrame, kept: list[str]) -> DataFrame:
        """Pairs of boxes that may hold the smallest distance of their key: dozens at first, then the near-best ones."""
        gaps = [F.greatest(F.col(f"{low}a") - F.col(f"{high}b"), F.col(f"{low}b") - F.col(f"{high}a"), F.lit(0.0)) for low, high in ("lr", "bt")]
        spans = [F.greatest(F.col(f"{high}a") - F.col(f"{low}b"), F.col(f"{high}b") - F.col(f"{low}a")) for low, high in ("lr", "bt")]
        low, high = (d[0] * d[0] + d[1] * d[1] for d in (gaps, spans))
        best = F.min(high).over(Window.partitionBy(key))
        return pairs.withColumn("__best", best).filter(low <= F.col("__best")).select(key, *kept)

    coarse = near(upper(a, "a").join(upper(b, "b"), key), ["cxa0", "cya0", "cxb0", "cyb0"])
    fine = near(coarse.join(a, [key, "cxa0", "cya0"]).join(b.drop("segsb"), [key, "cxb0", "cyb0"]), ["cxb0", "cyb0", "cxb1", "cyb1", "segsa"])
    place = F.struct("cxb0", "cyb0", "cxb1", "cyb1")
    asked = fine.groupBy(key, place.alias("__place")).agg(F.array_distinct(F.flatten(F.collect_list("segsa"))).alias("segsa"))
    asked = asked.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("__place", "segsa"))).alias("__asked"),
                                   F.min(F.element_at("segsa", 1)).alias("__start"))
    px, py = F.col("__start.x1a"), F.col("__start.y1a")
    met = (b.join(asked, key).withColumn("segsa", F.col("__asked")[place])
           .filter(F.col("segsa").isNotNull() | ((F.col("bb") <= py) & (F.col("tb") >= py) & (F.col("rb") >= px)))
           .select(key, px.alias("__px"), py.alias("__py"), "segsa", F.explode("segsb").alias("b"))
           .select(key, "__px", "__py", "b.*", F.posexplode_outer("segsa").alias("__i", "a")))
    line, edge = (tuple(F.col(f"{p}{c}{m}") for c in ("x1", "y1", "x2", "y2")) for m, p in (("a", "a."), ("b", "")))
    # Four ends against the other side, a row each: one small expression instead of one too large to be compiled.
    ends = [F.struct(*[c.alias(n) for c, n in zip((*p, *o), ("px", "py", "x1", "y1", "x2", "y2"))])
            for p, o in ((line[:2], edge), (line[2:], edge), (edge[:2], line), (edge[2:], line))]
    held = met.select("*", F.posexplode(F.array(*ends)).alias("__j", "e"))
    once = F.col("__j") == 0
    crossed = ray_crosses(F.col("__px"), F.col("__py"), *edge) & (F.coalesce("__i", F.lit(0)) == 0) & once
    told = held.groupBy(key).agg(F.min(point_segment_square(*[F.col(f"e.{c}") for c in ("px", "py", "x1", "y1", "x2", "y2")])).alias("__d"),
                                 F.count_if(crossed).alias("__n"), F.count_if(segments_cross(line, edge) & once).alias("__m"))
    return told.select(key, F.when((F.col("__n") % 2 == 1) | (F.col("__m") > 0), F.lit(0.0)).otherwise(F.sqrt("__d")).alias(out))
