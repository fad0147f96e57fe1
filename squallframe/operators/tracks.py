"""Best-track rows to track points and storms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import missing
from ..functions.calendar import parse_time
from ..functions.text import storm_label
from .keyed import join_keys, rank_rows, with_window_values


def parse_tracks(raw: DataFrame, basin: str | None = None, first: int | None = None,
                 last: int | None = None) -> DataFrame:
    """Typed rows of an all-text track table; the units row has no season number and falls out."""
    season = F.col("SEASON").try_cast("int")
    typed = raw.filter(season.isNotNull()).select(
        F.col("SID").alias("sid"), season.alias("season"), F.col("NUMBER").try_cast("int").alias("number"),
        F.trim("BASIN").alias("basin"), F.trim("NAME").alias("name"), parse_time(F.col("ISO_TIME")).alias("ts"),
        missing.number(F.col("LAT")).alias("center_lat"), missing.number(F.col("LON")).alias("center_lon"),
        missing.number(F.col("WMO_WIND")).alias("wind_kt"), missing.number(F.col("WMO_PRES")).alias("pressure_hpa"),
        missing.number(F.col("USA_RMW")).alias("rmw_nm"))
    if basin is not None:
        typed = typed.filter(F.col("basin") == basin)
    if first is not None:
        typed = typed.filter(F.col("season") >= first)
    if last is not None:
        typed = typed.filter(F.col("season") <= last)
    return typed


def label_storms(storms: DataFrame, season: str = "season", name: str = "name", number: str = "number",
                 sid: str = "sid") -> DataFrame:
    """{season}_{NAME}_{NUMBER}; all but the first storm of a shared label get their id appended."""
    labelled = storms.withColumn("__label", storm_label(F.col(season).cast("string"), F.col(name),
                                                        F.col(number).cast("string")))
    owner = labelled.groupBy(season, "__label").agg(F.min(sid).alias("__owner"))
    kept = join_keys(labelled, owner, [season, "__label"])
    return (kept.withColumn("label", F.when(F.col(sid) == F.col("__owner"), F.col("__label"))
                            .otherwise(F.concat_ws("_", "__label", F.col(sid).cast("string"))))
            .drop("__label", "__owner"))


def number_steps(points: DataFrame, storm: str, ts: str, *tie: str, out: str = "step") -> DataFrame:
    """0-based step of each point in its storm's time order, hour by hour."""
    ranked = rank_rows(points, [storm], [F.col(ts), *[F.col(t) for t in tie]], F.date_trunc("hour", ts), out)
    return ranked.withColumn(out, F.col(out) - 1)


def storm_summary(points: DataFrame, storm: str, ts: str, *attributes: str, tie: str = "event_id") -> DataFrame:
    """First and last value of the attributes in time order (``tie`` decides at equal times), and the life span."""
    order = F.struct(ts, tie)
    firsts = [F.min_by(a, order).alias(f"first_{a}") for a in attributes]
    lasts = [F.max_by(a, order).alias(f"last_{a}") for a in attributes]
    return points.groupBy(storm).agg(F.min(ts).alias("start_time"), F.max(ts).alias("end_time"),
                                     F.count(F.lit(1)).alias("n_points"), *firsts, *lasts)


def physical_violations(points: DataFrame, keys=()) -> DataFrame:
    """Counts of physically impossible values per variable."""
    bad = {
        "center_lat": ~F.col("center_lat").between(-90, 90), "center_lon": ~F.col("center_lon").between(-180, 180),
        "wind_kt": F.col("wind_kt") < 0, "pressure_hpa": ~F.col("pressure_hpa").between(850, 1100),
        "rmw_nm": F.col("rmw_nm") < 0}
    wide = points.groupBy(*keys).agg(*[F.count_if(c).alias(n) for n, c in bad.items()])
    return wide.unpivot(list(keys), list(bad), "variable", "n_illegal")


def distinct_track(points: DataFrame, storm: str, lon: str, lat: str, seq: str) -> DataFrame:
    """A storm's coordinates in order, each kept at its first visit and renumbered from 1."""
    firsts = (points.filter(F.col(lon).isNotNull() & F.col(lat).isNotNull())
              .groupBy(storm, lon, lat).agg(F.min(seq).alias(seq)))
    return rank_rows(firsts, [storm], [F.col(seq)], F.floor(F.col(seq) / 1000), "point_no")


def step_peaks(cells: DataFrame, storm: str, step: str, value: str, day: str, first=None, last=None) -> DataFrame:
    """Highest window value of every step in a date range."""
    ranged = cells
    if first is not None:
        ranged = ranged.filter(F.col(day) >= first)
    if last is not None:
        ranged = ranged.filter(F.col(day) <= last)
    return ranged.groupBy(storm, step, day).agg(F.max(value).alias("peak"))


def event_points(cells: DataFrame, keys: list[str], hazard: str, loss: str, row: str, col: str,
                 size: int, q: float = 0.9) -> DataFrame:
    """Cells worth keeping per step: hazard in the top share or any loss; else the strongest
    cell; else, without any valid hazard, the centre cell. Steps are windows of bounded size."""
    flagged = with_window_values(cells, keys, __q=F.percentile(hazard, F.lit(q)), __finite=F.count(hazard))
    hit = F.coalesce(F.col(hazard) >= F.col("__q"), F.lit(False)) & F.col(hazard).isNotNull()
    paid = F.coalesce(F.col(loss) > 0, F.lit(False))
    keep = F.when(F.col("__finite") > 0, hit | (paid & F.col(hazard).isNotNull())).otherwise(paid)
    centre = (F.col(row) == size // 2) & (F.col(col) == size // 2)
    strongest = Window.partitionBy(*keys).orderBy(F.col(hazard).desc_nulls_last(), row, col)
    rest = with_window_values(flagged.withColumn("__keep", keep).withColumn("__rank", F.row_number().over(strongest)), keys, __any=F.bool_or("__keep"))
    fallback = ~F.col("__any") & F.when(F.col("__finite") == 0, centre).otherwise(F.col("__rank") == 1)
    chosen = rest.filter(F.col("__keep") | fallback)
    kind = (F.when(hit & paid, "overlap").when(paid, "loss_only").otherwise("hazard_only"))
    return chosen.withColumn("point_class", kind).drop("__q", "__finite", "__keep", "__rank", "__any")
