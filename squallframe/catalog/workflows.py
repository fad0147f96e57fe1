"""Whole workflows over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import assets, attribution
from ..sources.sinks import save_table
from . import frames as fr
from .base import R, big, query, rounded, scratch_table


def _nation_word(nation):
    """A name of its own for every nation: one letter, four times."""
    return F.repeat(F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), nation.cast("int") + 1, F.lit(1)), F.lit(4))


def _iso(nation):
    return F.concat(F.lit("C"), F.lpad(nation.cast("string"), 2, "0"))


def shipment_windows(t):
    """Shipments of a nation and month as a storm, a step per day and a cell per line and supplier."""
    ship = F.col("l_shipdate").cast("date")
    nation = F.col("s_nationkey").cast("bigint")
    storm = nation * 1000 + (F.year(ship) - 1990) * 12 + F.month(ship)
    cells = (t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"))
             .groupBy(storm.alias("storm_id"), nation.alias("nation"), ship.alias("obs_date"),
                      F.col("l_linenumber").alias("wi"), (F.col("l_suppkey") % 41).alias("wj"))
             .agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("hazard"),
                  F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("asset")))
    return (cells.withColumn("step", F.dayofmonth("obs_date"))
            .withColumn("lon", fr.LON0 + (F.col("nation") % 8) * 10 + F.col("wj") * 0.25)
            .withColumn("lat", fr.LAT0 + F.floor(F.col("nation") / 8) * 11 + F.col("wi")))


E2E = f"""WITH {fr.RECORDS}, {fr.OUTLINES},
cells AS (SELECT s_nationkey * 1000 + (year(l_shipdate) - 1990) * 12 + month(l_shipdate) AS storm_id, CAST(s_nationkey AS BIGINT) AS nation, CAST(l_shipdate AS DATE) AS d,
    l_linenumber AS wi, l_suppkey % 41 AS wj, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS hazard, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS asset
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
placed AS (SELECT *, 100.0::DOUBLE + (nation % 8) * 10 + wj * 0.25::DOUBLE AS lon, 5.0::DOUBLE + (nation // 8) * 11 + wi AS lat FROM cells),
inside AS (SELECT lon, lat, unit_id FROM (SELECT DISTINCT lon, lat FROM placed) JOIN outlines
  ON (y1 > lat) <> (y2 > lat) AND lon < (x2 - x1) * (lat - y1) / nullif(y2 - y1, 0) + x1 GROUP BY ALL HAVING count(*) % 2 = 1),
storms AS (SELECT storm_id, nation, min(d) AS first_day, max(d) AS last_day FROM cells GROUP BY 1, 2),
recs AS (SELECT p.*, c_nationkey AS home FROM prepared p JOIN orders ON o_orderkey = rec_id JOIN customer ON o_custkey = c_custkey),
cand AS (SELECT rec_id, home, storm_id, nation = home AS same FROM recs JOIN storms ON pad_start <= last_day AND pad_end >= first_day),
k AS (SELECT rec_id, count(*) FILTER (same) AS n_same FROM cand GROUP BY 1),
chosen AS (SELECT rec_id, storm_id FROM cand JOIN k USING (rec_id) WHERE same OR n_same = 0),
w AS (SELECT r.rec_id, r.loss_usd, c.storm_id, c.wi, c.wj,
    CASE WHEN r.rec_id % 2 = 0 THEN CASE WHEN i.unit_id IS NOT NULL THEN 1 ELSE 0 END WHEN c.nation = r.home THEN (c.wj % 4) / 4.0::DOUBLE ELSE 0 END * hazard * asset AS p
  FROM recs r JOIN chosen USING (rec_id) JOIN placed c USING (storm_id) LEFT JOIN inside i ON i.lon = c.lon AND i.lat = c.lat AND i.unit_id = r.home
  WHERE r.loss_usd IS NOT NULL AND c.d BETWEEN r.pad_start AND r.pad_end),
s AS (SELECT rec_id, sum(p) AS sp, count(*) AS n FROM w GROUP BY 1)
SELECT rec_id, CASE WHEN n_same IS NULL THEN 'D' WHEN n_same = 0 THEN 'C' WHEN n_same = 1 THEN 'A' ELSE 'B' END AS grade,
  CASE WHEN rec_id % 2 = 0 THEN 'gadm_gid' ELSE 'iso_country' END AS source,
  CASE WHEN loss_usd IS NULL THEN 'missing_loss' WHEN n_same IS NULL THEN 'unmatched' WHEN coalesce(sp, 0) <= 0 THEN 'zero_weight' ELSE 'allocated' END AS status,
  {R("CASE WHEN loss_usd IS NOT NULL AND sp > 0 THEN loss_usd ELSE 0 END", 1)} AS allocated_usd
FROM recs LEFT JOIN k USING (rec_id) LEFT JOIN s USING (rec_id)"""


@query("e2e_loss_attribution", E2E)
def _(t):
    def keep(df, name):
        return save_table(df, scratch_table(t, f"e2e_{name}"))

    cells = keep(shipment_windows(t), "windows")
    nation = F.col("c_nationkey")
    gadm = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit('[{"gid_1": "'), _iso(nation), F.lit('.1_1"}]')))
    homes = (t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
             .select(F.col("o_orderkey").alias("rec_id"), _iso(nation).alias("iso"), _nation_word(nation).alias("event_name"),
                     gadm.alias("gadm_units"), F.lit(None).cast("string").alias("admin_units")))
    units = t.nation.select(big("n_nationkey").alias("unit_id"), F.lit(1).alias("level"), _iso(F.col("n_nationkey")).alias("gid0"),
                            F.concat(_iso(F.col("n_nationkey")), F.lit(".1_1")).alias("gid"), F.col("n_name").alias("name"))
    lookup = t.nation.select(big("n_nationkey").alias("country_id"), _iso(F.col("n_nationkey")).alias("iso3_final"))
    points = cells.select("storm_id", _nation_word(F.col("nation")).alias("storm_name"), "step", "obs_date").distinct()
    shares = cells.select("storm_id", "step", "wi", "wj", F.col("nation").alias("country_id"), ((F.col("wj") % 4) / 4.0).alias("share"))
    windows = cells.select("storm_id", "step", "wi", "wj", "lat", "lon", "hazard", "asset")
    got = attribution.attribute_losses(fr.records(t).join(homes, "rec_id"), points, windows, units, fr.outlines(t), lookup, shares, keep=keep)
    return got.summary.select("rec_id", "grade", "source", "status", rounded("allocated_usd", 1).alias("allocated_usd"))


@query("e2e_asset_layer", f"""WITH {fr.GRID}, {fr.PANEL},
w AS (SELECT y AS "year", "row", "col", zone, "value" * (y - 1990) * abs(signed) AS w FROM grid, range(1996, 1999) AS r(y)),
z AS (SELECT "year", zone, sum(w) AS zw FROM w WHERE zone > 0 GROUP BY 1, 2)
SELECT CAST(w."year" AS BIGINT) AS "year", "row", "col", {R('CASE WHEN gdp > 0 AND zw > 0 AND w > 0 THEN gdp * w / zw ELSE 0 END', 2)} AS asset
FROM w LEFT JOIN z ON z."year" = w."year" AND z.zone = w.zone LEFT JOIN panel p ON p.nation = w.zone AND p."year" = w."year" """)
def _(t):
    g = fr.grid(t)
    years = F.explode(F.sequence(F.lit(1996), F.lit(1998))).alias("year")
    light = g.select(years, "row", "col", "value").withColumn("value", F.col("value") * (F.col("year") - 1990))
    people = g.select(years, "row", "col", F.abs("signed").alias("value"))
    totals = fr.panel(t).withColumnRenamed("nation", "country_id").withColumn("is_missing", F.lit(0))
    layer = assets.asset_layer(light, people, g.select("row", "col", F.col("zone").alias("value")), totals)
    return layer.select(big("year").alias("year"), "row", "col", rounded("asset", 2).alias("asset"))
