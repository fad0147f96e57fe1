"""Scans and sinks (S and K rows of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.calendar import in_years
from ..operators.keyed import with_scalars
from ..operators.panel import indicator_rows, long_to_wide, wide_to_long
from ..operators.raster import downsample
from ..operators.spatial import boxes_meeting, unit_boxes
from ..operators.tracks import parse_tracks
from ..schemas import FLOOD_DOC
from ..sources import readers, sinks
from . import frames as fr
from .base import R, big, money, MONEY, query, rounded, scratch_table


def track_raw(t):
    """Events as an all-text best-track table with its units row and some unparsable cells."""
    e = F.col("event_id")
    rows = t.events.select(
        F.concat(F.lit("S"), F.col("user_id").cast("string")).alias("SID"), F.lit("2024").alias("SEASON"),
        F.when(e % 11 == 0, "n/a").otherwise(F.col("user_id").cast("string")).alias("NUMBER"),
        F.when(F.col("event_type") == "click", "WP").otherwise("EP").alias("BASIN"), F.lit(" NAMED ").alias("NAME"),
        F.when(e % 13 == 0, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("ISO_TIME"),
        F.when(e % 17 == 0, " ").otherwise((5 + (e % 450) / 10.0).cast("string")).alias("LAT"),
        (100 + (e * 7) % 800 / 10.0).cast("string").alias("LON"),
        F.when(e % 7 == 0, "-999").otherwise(F.col("value").cast("string")).alias("WMO_WIND"),
        (e % 1000).cast("string").alias("WMO_PRES"), F.lit("").alias("USA_RMW"))
    units = t.region.filter("r_regionkey = 0").select(*[
        F.lit(v).alias(c) for c, v in zip(rows.columns, ("", "Year", "", "", "", "", "degrees", "degrees", "kts", "mb", "nmile"))])
    return units.unionByName(rows)


@query("s1_track_scan", f"""
SELECT storm, count(*) AS n, count(num) AS n_number, count(tm) AS n_time, count(lat) AS n_lat, count(wind) AS n_wind,
       {R('sum(wind)', 4)} AS wind_sum
FROM (SELECT 'S' || user_id AS storm, CASE WHEN event_id % 11 <> 0 THEN 1 END AS num,
             CASE WHEN event_id % 13 <> 0 THEN 1 END AS tm, CASE WHEN event_id % 17 <> 0 THEN 1 END AS lat,
             CASE WHEN event_id % 7 <> 0 THEN "value" END AS wind
      FROM events WHERE event_type = 'click') GROUP BY storm""")
def _(t):
    typed = parse_tracks(track_raw(t), "WP", 2000, 2024)
    return typed.groupBy(F.col("sid").alias("storm")).agg(
        F.count(F.lit(1)).alias("n"), F.count("number").alias("n_number"), F.count("ts").alias("n_time"),
        F.count("center_lat").alias("n_lat"), F.count("wind_kt").alias("n_wind"),
        rounded(F.sum("wind_kt"), 4).alias("wind_sum"))


YEARS = list(range(1995, 2002))


def wide_accounts(t):
    """The panel as a wide all-text indicator table, once per indicator code."""
    wide = long_to_wide(fr.panel(t), ["nation"], YEARS, "gdp")
    text = wide.select(F.col("nation").cast("string").alias("iso3"),
                       *[F.col(f"y{y}").cast("string").alias(f"y{y}") for y in YEARS])
    return text.withColumn("indicator", F.explode(F.array(F.lit(" NY.GDP.MKTP.CD "), F.lit("SP.POP.TOTL"))))


@query("s2_header_rows_dropped", f"""WITH {fr.PANEL}
SELECT nation, count(*) AS n_years FROM panel GROUP BY nation""")
def _(t):
    wide = wide_accounts(t)
    header = t.region.filter("r_regionkey = 0").select(
        F.lit("Country Code").alias("iso3"), *[F.lit(str(y)).alias(f"y{y}") for y in YEARS],
        F.lit("Indicator Code").alias("indicator"))
    rows = indicator_rows(header.unionByName(wide), "NY.GDP.MKTP.CD")
    long = wide_to_long(rows, ["iso3"], YEARS).filter("gdp is not null")
    return long.groupBy(F.col("iso3").cast("bigint").alias("nation")).agg(F.count(F.lit(1)).alias("n_years"))


@query("s3_indicator_scan", f"""WITH {fr.PANEL}
SELECT CAST(nation AS VARCHAR) AS iso3, 'NY.GDP.MKTP.CD' AS indicator,
       {R('max(CASE WHEN "year" = 1996 THEN gdp END)', 2)} AS y1996, {R('max(CASE WHEN "year" = 2000 THEN gdp END)', 2)} AS y2000
FROM panel GROUP BY nation""")
def _(t):
    rows = indicator_rows(wide_accounts(t), "NY.GDP.MKTP.CD", required=["iso3", "indicator", "y1996", "y2000"])
    return rows.select("iso3", "indicator", rounded(F.col("y1996").try_cast("double"), 2).alias("y1996"),
                       rounded(F.col("y2000").try_cast("double"), 2).alias("y2000"))


@query("s4_records_by_year", f"""WITH {fr.RECORDS}
SELECT CAST(start_year AS BIGINT) AS start_year, CAST(start_month AS BIGINT) AS start_month, count(*) AS n, count(damage_kusd) AS n_raw
FROM records WHERE start_year BETWEEN 1996 AND 1998 GROUP BY 1, 2""")
def _(t):
    picked = fr.records(t).filter(in_years(F.col("start_year"), "1996-1998"))
    return picked.groupBy(big("start_year").alias("start_year"), big("start_month").alias("start_month")).agg(
        F.count(F.lit(1)).alias("n"), F.count("damage_kusd").alias("n_raw"))


@query("s5_outlines_in_box", f"""WITH {fr.OUTLINES}, {fr.POINTS},
area AS (SELECT min(center_lon) AS x0, min(center_lat) AS y0, max(center_lon) AS x1, max(center_lat) AS y1
         FROM points WHERE wind_kt > 200),
boxes AS (SELECT unit_id, min(least(x1, x2)) AS min_x, min(least(y1, y2)) AS min_y,
                 max(greatest(x1, x2)) AS max_x, max(greatest(y1, y2)) AS max_y FROM outlines GROUP BY unit_id)
SELECT unit_id, min_x, min_y, max_x, max_y FROM boxes, area WHERE max_x >= x0 AND min_x <= x1 AND max_y >= y0 AND min_y <= y1""")
def _(t):
    area = fr.points(t).filter("wind_kt > 200").agg(
        F.min("center_lon").alias("x0"), F.min("center_lat").alias("y0"), F.max("center_lon").alias("x1"), F.max("center_lat").alias("y1"))
    boxes = with_scalars(unit_boxes(fr.outlines(t)), area)
    return boxes_meeting(boxes, *[F.col(c) for c in ("x0", "y0", "x1", "y1")]).drop("x0", "y0", "x1", "y1")


@query("s6_flood_catalog", """
SELECT CAST(json_extract(props, '$.k') AS VARCHAR) AS flood_id, min(event_id) AS first_event,
       CAST(min_by(ts, lpad(CAST(event_id AS VARCHAR), 12, '0')) AS DATE) AS began
FROM events WHERE event_type <> 'error' GROUP BY 1""")
def _(t):
    k = F.get_json_object("props", "$.k")
    doc = F.to_json(F.struct(
        k.alias("id"), F.date_format("ts", "yyyy-MM-dd").alias("began"), F.date_format("ts", "yyyy-MM-dd").alias("ended"),
        F.lit("phl; vnm").alias("cc"), F.lit(" Tropical  Cyclone ").alias("dfo_main_cause"),
        F.when(F.col("event_type") != "error", F.lit("a.tif")).alias("tif")))
    path = F.lpad(F.col("event_id").cast("string"), 12, "0")
    parsed = t.events.select(path.alias("path"), F.from_json(doc, FLOOD_DOC).alias("d"))
    catalog = readers.flood_catalog(parsed.select("path", "d.*"))
    return catalog.select("flood_id", big("path").alias("first_event"), "began")


@query("s7_rain_file_days", """
SELECT CAST(DATE '2000-01-01' + CAST(page_id AS INTEGER) AS DATE) AS "day", count(*) AS n
FROM pages WHERE url NOT LIKE '%.html' GROUP BY 1""")
def _(t):
    name = F.concat(F.lit("/rain/3B-DAY.MS.MRG.3IMERG."),
                    F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), F.col("page_id").cast("int")), "yyyyMMdd"),
                    F.lit("-S000000.nc4"))
    files = t.pages.select(F.when(F.col("url").endswith(".html"), F.col("url")).otherwise(name).alias("path"))
    return readers.rain_days(files).groupBy("day").agg(F.count(F.lit(1)).alias("n"))


@query("s8_source_day_index", f"""WITH {fr.DAILY}
SELECT var, "day", count(*) AS n_cells FROM daily GROUP BY 1, 2""")
def _(t):
    return fr.daily(t).groupBy("var", "day").agg(F.count(F.lit(1)).alias("n_cells"))


PATTERNS = ("page=", "utm_source", "#top$", r"\.html$")


@query("s9_first_pattern_file", """
SELECT site, pattern_rank, url FROM (
  SELECT *, row_number() OVER (PARTITION BY site ORDER BY pattern_rank, url) AS rn FROM (
    SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS site, url,
           CASE WHEN url LIKE '%page=%' THEN 0 WHEN url LIKE '%utm_source%' THEN 1 WHEN url LIKE '%#top' THEN 2
                WHEN url LIKE '%.html' THEN 3 END AS pattern_rank FROM pages) WHERE pattern_rank IS NOT NULL) WHERE rn = 1""")
def _(t):
    files = t.pages.select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("site"), "url")
    return readers.first_match(files, ["site"], PATTERNS, "url").select("site", "pattern_rank", "url")


@query("s10_classify_names", """
SELECT kind, lang, count(*) AS n, max(url) AS last_url FROM (
  SELECT url, regexp_extract(url, '/([a-z]{2})/', 1) AS lang,
         CASE WHEN url LIKE '%.html' THEN 'average' WHEN url LIKE '%utm_source%' THEN 'count'
              WHEN url LIKE '%#top' THEN 'ignored' ELSE 'unknown' END AS kind FROM pages) GROUP BY 1, 2""")
def _(t):
    files = readers.classify_names(t.pages, {"average": r"\.html$", "count": "utm_source", "ignored": "#top$"}, "url")
    return files.groupBy("kind", F.regexp_extract("url", "/([a-z]{2})/", 1).alias("lang")).agg(
        F.count(F.lit(1)).alias("n"), F.max("url").alias("last_url"))


@query("s11_hyperslab", f"""WITH {fr.GRID},
spine AS (SELECT zone, min("row") - 2 AS r0, CAST(max("col") - 3 AS BIGINT) AS c0 FROM grid GROUP BY zone),
wanted AS (SELECT zone, r0 + i AS "row", c0 + j AS "col" FROM spine, range(6) AS a(i), range(6) AS b(j))
SELECT w.zone, w."row", w."col", {R('g."value"')} AS "value" FROM wanted w LEFT JOIN grid g ON g."row" = w."row" AND g."col" = w."col" """)
def _(t):
    g = fr.grid(t)
    spine = g.groupBy("zone").agg((F.min("row") - 2).alias("r0"), (F.max("col") - 3).alias("c0"))
    slab = readers.hyperslab(g.select("row", "col", "value"), F.col("r0"), F.col("c0"), 6, 6, spine)
    return slab.select("zone", "row", "col", rounded("value").alias("value"))


BANDS = """bands AS (SELECT "row", "col", "value" AS flooded, signed AS duration, CAST("value" < 2 AS INTEGER) AS permwater FROM grid)"""


def bands(t):
    return fr.grid(t).select("row", "col", F.col("value").alias("flooded"), F.col("signed").alias("duration"),
                             (F.col("value") < 2).cast("int").alias("permwater"))


@query("s12_band_samples", f"""WITH {fr.ANCHORS}, {fr.GRID}, {BANDS}
SELECT event_id, {R('flooded')} AS flooded, {R('duration')} AS duration, CAST(permwater AS BIGINT) AS permwater
FROM anchors a LEFT JOIN bands b ON a."row" = b."row" AND a."col" = b."col" """)
def _(t):
    got = readers.sample_bands(fr.anchors(t), bands(t), [])
    return got.select("event_id", rounded("flooded").alias("flooded"), rounded("duration").alias("duration"),
                      big("permwater").alias("permwater"))


@query("s13_downsampled", f"""WITH {fr.GRID}
SELECT CAST(floor("row" / 8.0) AS BIGINT) AS "row", CAST(floor("col" / 8.0) AS BIGINT) AS "col", {R('avg("value")')} AS "value"
FROM grid GROUP BY 1, 2""")
def _(t):
    return downsample(fr.grid(t), 8).select("row", "col", rounded("value").alias("value"))


@query("s14_day_slice", f"""WITH {fr.DAILY}
SELECT lat_idx, lon_idx, {R('"value"')} AS "value" FROM daily WHERE var = 'view' AND "day" = DATE '2024-01-15'""")
def _(t):
    return readers.day_slice(fr.daily(t), "view", "2024-01-15").select("lat_idx", "lon_idx", rounded("value").alias("value"))


@query("s15_text_without_bom", """
SELECT source, count(*) AS n FROM documents GROUP BY source""")
def _(t):
    marked = t.documents.select(F.concat(F.lit("﻿"), F.col("source")).alias("source"))
    return marked.groupBy(tx.without_bom(F.col("source")).alias("source")).agg(F.count(F.lit(1)).alias("n"))


@query("s16_country_lookup", """
SELECT c_custkey, CAST(n_nationkey AS BIGINT) AS country_id, upper(trim(n_name)) AS iso3_final
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def _(t):
    raw = t.nation.select(F.concat(F.lit(" "), F.lower("n_name"), F.lit(" ")).alias("iso3_final"), big("n_nationkey").alias("country_id"))
    lookup = readers.country_lookup(raw)
    return t.customer.join(lookup, F.col("c_nationkey") == F.col("country_id")).select("c_custkey", "country_id", "iso3_final")


@query("s17_years_filter", f"""
SELECT CAST(year(o_orderdate) AS BIGINT) AS "year", count(*) AS n, {MONEY('o_totalprice')} AS total
FROM orders WHERE year(o_orderdate) IN (1995, 1997, 1998, 1999) GROUP BY 1""")
def _(t):
    year = F.year("o_orderdate")
    return t.orders.filter(in_years(year, "1995,1997-1999")).groupBy(big(year).alias("year")).agg(
        F.count(F.lit(1)).alias("n"), money("o_totalprice").alias("total"))


@query("k1_csv_table", f"""
SELECT c_custkey, c_name, CASE WHEN c_acctbal > 0 THEN {R('c_acctbal', 2)} END AS balance, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment || ', "quoted"' END AS segment FROM customer""")
def _(t):
    """Written as CSV and read back: numbers, missing values, commas and quotes survive."""
    segment = F.when(F.col("c_mktsegment") != "BUILDING", F.concat("c_mktsegment", F.lit(', "quoted"')))
    rows = t.customer.select("c_custkey", "c_name", F.when(F.col("c_acctbal") > 0, rounded("c_acctbal", 2)).alias("balance"), segment.alias("segment"))
    return sinks.save_table(rows, scratch_table(t, "k1_csv"), "csv", header="true", escape='"')


@query("k2_json_manifest", f"""
SELECT CAST(year(o_orderdate) AS BIGINT) AS "year", count(*) AS n, {MONEY('o_totalprice')} AS total, list_sort(list(DISTINCT o_orderstatus)) AS statuses FROM orders GROUP BY 1""")
def _(t):
    facts = t.orders.groupBy(big(F.year("o_orderdate")).alias("year")).agg(
        F.count(F.lit(1)).alias("n"), money("o_totalprice").alias("total"), F.array_sort(F.collect_set("o_orderstatus")).alias("statuses"))
    return sinks.save_table(facts, scratch_table(t, "k2_manifest"), "json")


@query("k3_pending_partitions", """
SELECT DISTINCT CAST(n_nationkey AS BIGINT) AS nation, CAST(y AS BIGINT) AS "year", CAST(m AS BIGINT) AS "month"
FROM nation, range(1995, 2002) AS a(y), range(1, 13) AS b(m)
WHERE NOT EXISTS (SELECT 1 FROM orders JOIN customer ON o_custkey = c_custkey
                  WHERE c_nationkey = n_nationkey AND year(o_orderdate) = y AND month(o_orderdate) = m)""")
def _(t):
    planned = (t.nation.select(big("n_nationkey").alias("nation"), F.explode(F.sequence(F.lit(1995), F.lit(2001))).alias("year"))
               .withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12)))))
    done = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        big("c_nationkey").alias("nation"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"))
    return sinks.pending(planned, done, ["nation", "year", "month"]).select("nation", big("year").alias("year"), big("month").alias("month"))


@query("k5_enrich_stage", f"""
SELECT o_orderkey, o_orderstatus, {R('sum_qty', 2)} AS sum_qty FROM orders LEFT JOIN
  (SELECT l_orderkey, sum(l_quantity) AS sum_qty FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""")
def _(t):
    extra = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("sum_qty"))
    stage = t.orders.select("o_orderkey", "o_orderstatus")
    return sinks.enrich(stage, extra, ["o_orderkey"], ["sum_qty"]).withColumn("sum_qty", rounded("sum_qty", 2))


@query("k6_replace_variables", f"""
SELECT p_partkey, p_brand, {R('price')} AS p_retailprice FROM part LEFT JOIN
  (SELECT l_partkey, {MONEY('l_extendedprice')} / sum(l_quantity) AS price FROM lineitem GROUP BY 1) ON p_partkey = l_partkey""")
def _(t):
    fresh = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        (money("l_extendedprice") / F.sum("l_quantity")).alias("p_retailprice"))
    stage = sinks.limit_groups(t.part.select("p_partkey", "p_brand", "p_retailprice"), "p_brand", "^Brand#")
    return sinks.replace_variables(stage, ["p_retailprice"], fresh, ["p_partkey"]).withColumn(
        "p_retailprice", rounded("p_retailprice"))


@query("k7_plot_table", f"""
SELECT CAST(year(l_shipdate) AS BIGINT) AS "year", l_returnflag, count(*) AS n, {MONEY('l_extendedprice')} AS total
FROM lineitem GROUP BY 1, 2""")
def _(t):
    df = t.lineitem.groupBy(big(F.year("l_shipdate")).alias("year"), "l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), money("l_extendedprice").alias("total"))
    return sinks.plot_table(df, ["year", "l_returnflag", "n", "total"], ["year", "l_returnflag"])
