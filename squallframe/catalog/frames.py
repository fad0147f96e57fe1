"""The given tables seen as storm tracks, grids, records and outlines.

Each frame exists twice: as a DataFrame and as a SQL common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import GridSpec
from ..operators.tracks import number_steps
from .base import Tables

# The area the derived track coordinates lie in.
LAT0, LON0 = 5.0, 100.0
TRACK_GRID = GridSpec(lat_max=50.0, lon_min=100.0, lat_res=0.1, lon_res=1.25)


def grid(t: Tables) -> DataFrame:
    """Embeddings as a grid: a row per vector, a column per position, label as zone."""
    return (t.embeddings.select(F.col("vec_id").alias("row"), F.col("label").cast("bigint").alias("zone"),
                                F.posexplode("embedding").alias("col", "__v"))
            .select("row", F.col("col").cast("bigint").alias("col"), "zone",
                    (F.abs(F.col("__v").cast("double")) * 120).alias("value"),
                    F.col("__v").cast("double").alias("signed")))


GRID = """grid AS (
  SELECT vec_id AS "row", CAST(i - 1 AS BIGINT) AS "col", CAST(label AS BIGINT) AS zone,
         abs(CAST(v AS DOUBLE)) * 120 AS "value", CAST(v AS DOUBLE) AS signed
  FROM (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings))"""


def points(t: Tables) -> DataFrame:
    """Events as track points, without the step number."""
    e = F.col("event_id")
    return t.events.select(
        e.alias("event_id"), F.col("user_id").alias("storm_id"), F.col("event_type").alias("basin"), "ts",
        F.col("ts").cast("date").alias("obs_date"),
        (F.lit(LAT0) + (e % 450) / F.lit(10.0)).alias("center_lat"),
        (F.lit(LON0) + ((e * 7) % 800) / F.lit(10.0)).alias("center_lon"),
        F.col("value").alias("wind_kt"), (F.lit(840.0) + (e % 280)).alias("pressure_hpa"),
        ((e % 60) - F.lit(3.0)).alias("rmw_nm"))


POINTS = """points AS (
  SELECT event_id, user_id AS storm_id, event_type AS basin, ts, CAST(ts AS DATE) AS obs_date,
         5.0::DOUBLE + (event_id % 450) / 10.0::DOUBLE AS center_lat,
         100.0::DOUBLE + ((event_id * 7) % 800) / 10.0::DOUBLE AS center_lon,
         "value" AS wind_kt, 840.0::DOUBLE + (event_id % 280) AS pressure_hpa,
         (event_id % 60) - 3.0::DOUBLE AS rmw_nm
  FROM events)"""


def tracks(t: Tables) -> DataFrame:
    return number_steps(points(t), "storm_id", "ts", "event_id")


TRACKS = POINTS + """, tracks AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY storm_id ORDER BY ts, event_id) - 1 AS BIGINT) AS step FROM points)"""


def anchors(t: Tables) -> DataFrame:
    """Track points placed on the grid."""
    return points(t).select("event_id", TRACK_GRID.row(F.col("center_lat")).alias("row"),
                            TRACK_GRID.col(F.col("center_lon")).alias("col"))


ANCHORS = POINTS + """, anchors AS (
  SELECT event_id, CAST(floor((50.0::DOUBLE - center_lat) / 0.1::DOUBLE) AS BIGINT) AS "row",
         CAST(floor((center_lon - 100.0::DOUBLE) / 1.25::DOUBLE) AS BIGINT) AS "col" FROM points)"""


def daily(t: Tables) -> DataFrame:
    """Events averaged on a half-degree by one-degree daily grid, a variable per event type."""
    p = points(t)
    return (p.groupBy(F.col("basin").alias("var"), F.col("obs_date").alias("day"),
                      F.floor((F.col("center_lat") - LAT0) / 0.5).alias("lat_idx"),
                      F.floor(F.col("center_lon") - LON0).alias("lon_idx"))
            .agg((F.sum(F.col("wind_kt").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))).alias("value")))


DAILY = POINTS + """, daily AS (
  SELECT basin AS var, obs_date AS day, CAST(floor((center_lat - 5.0::DOUBLE) / 0.5::DOUBLE) AS BIGINT) AS lat_idx,
         CAST(floor(center_lon - 100.0::DOUBLE) AS BIGINT) AS lon_idx,
         CAST(sum(CAST(wind_kt AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS "value"
  FROM points GROUP BY ALL)"""


def records(t: Tables) -> DataFrame:
    """Orders as disaster records with gaps in dates and losses."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    end = F.date_add(day, (k % 20).cast("int"))
    status = F.col("o_orderstatus")
    return t.orders.select(
        k.alias("rec_id"), F.year(day).alias("start_year"), F.month(day).alias("start_month"),
        F.when(k % 3 != 0, F.dayofmonth(day)).alias("start_day"),
        F.year(end).alias("end_year"), F.month(end).alias("end_month"),
        F.when(k % 5 != 0, F.dayofmonth(end)).alias("end_day"),
        F.when(status == "O", F.col("o_totalprice")).alias("damage_adj_kusd"),
        F.when(status == "F", F.col("o_totalprice")).alias("damage_kusd"), day.alias("day"))


RECORDS = """records AS (
  SELECT o_orderkey AS rec_id, year(d) AS start_year, month(d) AS start_month,
         CASE WHEN o_orderkey % 3 <> 0 THEN day(d) END AS start_day, year(e) AS end_year, month(e) AS end_month,
         CASE WHEN o_orderkey % 5 <> 0 THEN day(e) END AS end_day,
         CASE WHEN o_orderstatus = 'O' THEN o_totalprice END AS damage_adj_kusd,
         CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS damage_kusd, d AS "day"
  FROM (SELECT *, CAST(o_orderdate AS DATE) AS d,
               CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 20 AS INTEGER) AS DATE) AS e FROM orders)),
prepared AS (
  SELECT *, start_date - 1 AS pad_start, end_date + 1 AS pad_end FROM (
    SELECT *, make_date(start_year, start_month, coalesce(start_day, 1)) AS start_date,
           CASE WHEN end_day IS NULL THEN last_day(make_date(end_year, end_month, 1))
                ELSE make_date(end_year, end_month, end_day) END AS end_date,
           CAST(start_day IS NULL OR end_day IS NULL AS INTEGER) AS date_imputed,
           coalesce(damage_adj_kusd, damage_kusd) * 1000.0::DOUBLE AS loss_usd,
           CASE WHEN damage_adj_kusd IS NOT NULL THEN 'adjusted' WHEN damage_kusd IS NOT NULL THEN 'raw_fallback'
                ELSE 'missing' END AS loss_source FROM records))"""


def lives(t: Tables) -> DataFrame:
    """Life span of each (supplier nation, shipping month) as if it were a storm."""
    ship = F.col("l_shipdate").cast("date")
    return (t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
            .groupBy(F.col("s_nationkey").cast("bigint").alias("nation"), F.trunc(ship, "month").alias("month"))
            .agg(F.min(ship).alias("first_day"), F.max(ship).alias("last_day")))


LIVES = """lives AS (
  SELECT CAST(s_nationkey AS BIGINT) AS nation, CAST(date_trunc('month', l_shipdate) AS DATE) AS "month",
         CAST(min(l_shipdate) AS DATE) AS first_day, CAST(max(l_shipdate) AS DATE) AS last_day
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"""


def weights(t: Tables) -> DataFrame:
    """Line items as window cells under a mask."""
    return t.lineitem.select(
        F.col("l_orderkey").alias("rec_id"), F.col("l_linenumber").cast("bigint").alias("wi"),
        (F.col("l_suppkey") % 41).alias("wj"), F.col("l_quantity").alias("hazard"),
        F.col("l_extendedprice").alias("asset"), (F.col("l_returnflag") != "R").cast("int").alias("mask"),
        F.col("l_shipdate").cast("date").alias("day"))


WEIGHTS = """weights AS (
  SELECT l_orderkey AS rec_id, CAST(l_linenumber AS BIGINT) AS wi, l_suppkey % 41 AS wj, l_quantity AS hazard,
         l_extendedprice AS asset, CAST(l_returnflag <> 'R' AS INTEGER) AS mask, CAST(l_shipdate AS DATE) AS "day"
  FROM lineitem)"""

# Corners of the outline every nation gets, relative to its own origin.
CORNERS = ((0, 0), (9, 1), (7, 8), (4, 5), (1, 9))


def outlines(t: Tables) -> DataFrame:
    """One concave outline per nation as edges."""
    x0 = F.lit(LON0) + (F.col("n_nationkey") % 8) * 10
    y0 = F.lit(LAT0) + F.floor(F.col("n_nationkey") / 8) * 11
    edges = F.array(*[F.struct((x0 + a[0]).alias("x1"), (y0 + a[1]).alias("y1"),
                               (x0 + b[0]).alias("x2"), (y0 + b[1]).alias("y2"))
                      for a, b in zip(CORNERS, CORNERS[1:] + CORNERS[:1])])
    return (t.nation.select(F.col("n_nationkey").cast("bigint").alias("unit_id"), F.explode(edges).alias("e"))
            .select("unit_id", "e.*"))


OUTLINES = """outlines AS (
  SELECT CAST(n_nationkey AS BIGINT) AS unit_id, 100.0::DOUBLE + (n_nationkey % 8) * 10 + ax AS x1,
         5.0::DOUBLE + (n_nationkey // 8) * 11 + ay AS y1, 100.0::DOUBLE + (n_nationkey % 8) * 10 + bx AS x2,
         5.0::DOUBLE + (n_nationkey // 8) * 11 + by_ AS y2
  FROM nation, (VALUES (0, 0, 9, 1), (9, 1, 7, 8), (7, 8, 4, 5), (4, 5, 1, 9), (1, 9, 0, 0)) AS c(ax, ay, bx, by_))"""


def monthly(t: Tables) -> DataFrame:
    """Parts by shipping month as monthly composites (in whole cents) with a weight."""
    ship = F.col("l_shipdate")
    return (t.lineitem.groupBy(F.col("l_partkey").alias("cell"), F.year(ship).alias("year"), F.month(ship).alias("month"))
            .agg((F.sum(F.col("l_extendedprice").cast("decimal(18,2)")) * 100).cast("double").alias("avg_rad"),
                 F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("cf_cvg")))


MONTHLY = """monthly AS (
  SELECT l_partkey AS cell, year(l_shipdate) AS "year", month(l_shipdate) AS "month",
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) * 100 AS DOUBLE) AS avg_rad,
         CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS cf_cvg
  FROM lineitem GROUP BY 1, 2, 3)"""


def yearly(t: Tables) -> DataFrame:
    """Quantity shipped per part and year, in hundreds: a yearly layer series."""
    return t.lineitem.groupBy(F.col("l_partkey").alias("cell"), F.year("l_shipdate").alias("year")).agg(
        (F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double") / F.lit(10.0)).alias("value"))


YEARLY = """yearly AS (
  SELECT l_partkey AS cell, year(l_shipdate) AS "year",
         CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / 10.0::DOUBLE AS "value"
  FROM lineitem GROUP BY 1, 2)"""


def panel(t: Tables) -> DataFrame:
    """Order totals by nation and year as national accounts."""
    return (t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
            .groupBy(F.col("c_nationkey").cast("bigint").alias("nation"), F.year("o_orderdate").alias("year"))
            .agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("gdp")))


PANEL = """panel AS (
  SELECT CAST(c_nationkey AS BIGINT) AS nation, year(o_orderdate) AS "year",
         CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS gdp
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""
