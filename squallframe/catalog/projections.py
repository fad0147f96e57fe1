"""Projections, predicates and scalar functions (P and C rows of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import geo, hazard, missing
from ..functions import status as st
from ..functions import text as tx
from ..operators.matching import name_scores, prepare_records
from ..operators.panel import apply_overrides
from ..operators.quality import sampled_digest
from ..operators.tracks import label_storms, physical_violations
from ..operators.windows import absolute_coordinates, nearest_index, window_offsets
from ..sources import readers
from . import frames as fr
from .base import R, big, n_rows, query, rounded


@query("p1_basin_season_filter", """
SELECT event_type AS basin, count(*) AS n FROM events WHERE event_type = 'click' AND year(ts) BETWEEN 2000 AND 2024 GROUP BY 1""")
def _(t):
    return t.events.filter((F.col("event_type") == "click") & F.year("ts").between(2000, 2024)).groupBy(
        F.col("event_type").alias("basin")).agg(n_rows())


@query("p2_number_coercion", f"""
SELECT event_id, CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 OR event_id % 11 = 0 THEN NULL ELSE {R('"value"')} END AS number,
       CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 OR event_id % 11 = 0 THEN -999.0::DOUBLE ELSE {R('"value"')} END AS filled
FROM events""")
def _(t):
    e = F.col("event_id")
    raw = (F.when(e % 5 == 0, "n/a").when(e % 7 == 0, "-999").when(e % 11 == 0, "NaN")
           .otherwise(F.col("value").cast("string")))
    number = missing.number(raw)
    return t.events.select("event_id", rounded(number).alias("number"),
                           rounded(missing.with_fill(number, missing.TRACK_FILL)).alias("filled"))


@query("p3_time_parse", """
SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN CAST(ts AS DATE) END AS "day",
       CASE WHEN event_id % 9 <> 0 THEN CAST(hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)) AS BIGINT) END AS second_of_day
FROM events""")
def _(t):
    text = F.when(F.col("event_id") % 9 == 0, "31/31/2024").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    parsed = cal.parse_time(text)
    return t.events.select("event_id", parsed.cast("date").alias("day"),
                           big(F.hour(parsed) * 3600 + F.minute(parsed) * 60 + F.second(parsed)).alias("second_of_day"))


@query("p4_hours_since_epoch", f"""
SELECT event_id, {R('epoch_us(ts) / 3600000000.0::DOUBLE')} AS hours FROM events""")
def _(t):
    return t.events.select("event_id", rounded(cal.epoch_hours(F.col("ts"))).alias("hours"))


@query("p5_valid_coordinates", """
SELECT event_type, count(*) AS n, count(*) FILTER (NOT ok) AS n_invalid FROM (
  SELECT event_type, (event_id % 1900) / 10.0::DOUBLE - 95 BETWEEN -90 AND 90
         AND (event_id % 3700) / 10.0::DOUBLE - 185 BETWEEN -180 AND 180 AS ok FROM events) GROUP BY 1""")
def _(t):
    e = F.col("event_id")
    ok = geo.valid_coordinate((e % 1900) / 10.0 - 95, (e % 3700) / 10.0 - 185)
    return t.events.groupBy("event_type").agg(n_rows(), F.count_if(~ok).alias("n_invalid"))


@query("p6_nonnegative", f"""WITH {fr.GRID}
SELECT zone, count(*) AS n, count(*) FILTER (signed <= 0 OR signed > 0.3) AS n_zero,
       {R('sum(CASE WHEN signed > 0 AND signed <= 0.3 THEN signed ELSE 0 END)', 4)} AS total FROM grid GROUP BY 1""")
def _(t):
    v = F.when(F.col("signed") > 0.3, F.lit(float("nan"))).otherwise(F.col("signed"))
    clean = fr.grid(t).withColumn("v", missing.nonnegative(v))
    return clean.groupBy("zone").agg(n_rows(), F.count_if(F.col("v") == 0).alias("n_zero"), rounded(F.sum("v"), 4).alias("total"))


@query("p7_clamp", f"""WITH {fr.GRID}
SELECT "row", "col", {R('CASE WHEN "col" % 10 <> 9 THEN least(greatest(signed * 300, 0), 63) END')} AS "value" FROM grid""")
def _(t):
    v = F.when(F.col("col") % 10 != 9, F.col("signed") * 300)
    return fr.grid(t).select("row", "col", rounded(missing.clamp(v, 0.0, 63.0)).alias("value"))


@query("p8_valid_mask", f"""WITH {fr.GRID}
SELECT "col", count(*) AS n, count(*) FILTER ("row" % 5 = 4) AS n_valid, count(*) FILTER ("row" % 5 = 4) AS n_valid_single FROM grid GROUP BY 1""")
def _(t):
    v = (F.when(F.col("row") % 5 == 0, -999.0).when(F.col("row") % 5 == 1, -9999.0).when(F.col("row") % 5 == 2, -9999.9)
         .when(F.col("row") % 5 == 3, float("nan")).otherwise(F.col("value")))
    return fr.grid(t).groupBy("col").agg(n_rows(), F.count_if(missing.is_valid(v)).alias("n_valid"),
                                        F.count_if(missing.is_valid(v.cast("float"))).alias("n_valid_single"))


@query("p9_physical_ranges", f"""WITH {fr.POINTS}
SELECT basin, variable, n_illegal FROM (
  SELECT basin, count(*) FILTER (center_lat NOT BETWEEN -90 AND 90) AS center_lat,
         count(*) FILTER (center_lon NOT BETWEEN -180 AND 180) AS center_lon, count(*) FILTER (wind_kt < 0) AS wind_kt,
         count(*) FILTER (pressure_hpa NOT BETWEEN 850 AND 1100) AS pressure_hpa, count(*) FILTER (rmw_nm < 0) AS rmw_nm
  FROM points GROUP BY 1) UNPIVOT (n_illegal FOR variable IN (center_lat, center_lon, wind_kt, pressure_hpa, rmw_nm))""")
def _(t):
    return physical_violations(fr.points(t), ["basin"])


OVERRIDES = [("NATION_3", "NATION_4"), ("NATION_7", "NATION_4"), ("NATION_11", "NATION_12")]


@query("p10_code_overrides", """
SELECT n_name AS code, coalesce(p, n_name) AS iso3_final, CAST(p IS NOT NULL AS BIGINT) AS is_disputed,
       CASE WHEN p IS NOT NULL THEN n_name || '->' || p END AS rule, count(*) AS n_customers
FROM customer JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN (VALUES ('NATION_3', 'NATION_4'), ('NATION_7', 'NATION_4'), ('NATION_11', 'NATION_12')) AS o(c, p) ON c = n_name
GROUP BY ALL""")
def _(t):
    rules = t.spark.createDataFrame(OVERRIDES, "code string, parent string")
    coded = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("iso"))
    mapped = apply_overrides(coded, rules, "iso")
    return mapped.groupBy(F.col("iso").alias("code"), "iso3_final", big("is_disputed").alias("is_disputed"), "rule").agg(
        F.count(F.lit(1)).alias("n_customers"))


@query("p11_absolute_coordinates", f"""WITH {fr.POINTS},
o AS (SELECT CAST(i AS BIGINT) AS i, -5.0::DOUBLE + 10.0::DOUBLE * i / 4 AS d FROM range(5) AS r(i))
SELECT event_id, a.i AS wi, b.i AS wj, {R('center_lat + a.d')} AS lat,
       {R('fmod(fmod(center_lon + 100 + b.d + 180, 360) + 360, 360) - 180')} AS lon
FROM points, o a, o b""")
def _(t):
    p = fr.points(t).select("event_id", "center_lat", (F.col("center_lon") + 100).alias("center_lon"))
    cells = absolute_coordinates(p, window_offsets(5, 5.0))
    return cells.select("event_id", big("wi").alias("wi"), big("wj").alias("wj"), rounded("lat").alias("lat"), rounded("lon").alias("lon"))


@query("p12_normalise_longitude", f"""
SELECT event_id, {R('CASE WHEN x < 0 THEN x + 360 ELSE x END')} AS lon
FROM (SELECT event_id, (event_id % 3600) / 10.0::DOUBLE - 180 AS x FROM events)""")
def _(t):
    x = (F.col("event_id") % 3600) / 10.0 - 180
    return t.events.select("event_id", rounded(geo.negative_to_360(x)).alias("lon"))


@query("p13_storm_labels", """
SELECT sid, season, CASE WHEN rn > 1 THEN base || '_' || sid ELSE base END AS label FROM (
  SELECT p_partkey AS sid, season, base, row_number() OVER (PARTITION BY season, base ORDER BY p_partkey) AS rn FROM (
    SELECT p_partkey, CAST(2000 + p_size % 25 AS BIGINT) AS season,
           concat_ws('_', 2000 + p_size % 25, replace(upper(p_name), ' ', '_'), p_size) AS base FROM part))""")
def _(t):
    storms = t.part.select(F.col("p_partkey").alias("sid"), big(2000 + F.col("p_size") % 25).alias("season"),
                           F.upper("p_name").alias("name"), F.col("p_size").alias("number"))
    return label_storms(storms).select("sid", "season", "label")


@query("p14_name_in_label", """
SELECT p_partkey, replace(p_name, ' ', '_') AS name FROM part""")
def _(t):
    label = tx.storm_label(F.lit("2013"), F.col("p_name"), F.col("p_size").cast("string"))
    return t.part.select("p_partkey", tx.name_in_label(label).alias("name"))


@query("p15_loss_preference", f"""WITH {fr.RECORDS}
SELECT rec_id, {R('loss_usd', 2)} AS loss_usd, loss_source FROM prepared""")
def _(t):
    return prepare_records(fr.records(t)).select("rec_id", rounded("loss_usd", 2).alias("loss_usd"), "loss_source")


@query("p16_date_imputation", f"""WITH {fr.RECORDS}
SELECT rec_id, start_date, end_date, CAST(pad_start AS DATE) AS pad_start, CAST(pad_end AS DATE) AS pad_end,
       CAST(date_imputed AS BIGINT) AS date_imputed FROM prepared""")
def _(t):
    return prepare_records(fr.records(t)).select("rec_id", "start_date", "end_date", "pad_start", "pad_end",
                                                 big("date_imputed").alias("date_imputed"))


@query("p17_date_layouts", """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN CAST(o_orderdate AS DATE) END AS "day" FROM orders""")
def _(t):
    k = F.col("o_orderkey") % 4
    text = (F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "yyyy/MM/dd"))
            .when(k == 2, F.date_format("o_orderdate", "yyyyMMdd")).otherwise("soon"))
    return t.orders.select("o_orderkey", cal.parse_date(text).alias("day"))


@query("p18_grade_priority", """
SELECT o_orderpriority, o_orderstatus, CAST(CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 0 WHEN '2' THEN 1 WHEN '3' THEN 2 WHEN '4' THEN 3 ELSE 4 END AS BIGINT) AS priority,
       CASE o_orderstatus WHEN 'O' THEN 'PASS' WHEN 'P' THEN 'WARN' ELSE 'FAIL' END AS status, count(*) AS n FROM orders GROUP BY ALL""")
def _(t):
    grade = F.translate(F.substring("o_orderpriority", 1, 1), "12345", "abcdx")
    code = F.when(F.col("o_orderstatus") == "O", 1).when(F.col("o_orderstatus") == "P", 2).otherwise(3)
    return t.orders.groupBy("o_orderpriority", "o_orderstatus", big(st.grade_priority(grade)).alias("priority"),
                            st.status_of(code).alias("status")).agg(n_rows())


@query("p19_evaluation_windows", """
SELECT CAST(y AS BIGINT) AS "year", CASE WHEN y BETWEEN 2000 AND 2018 THEN 'core' WHEN y BETWEEN 2019 AND 2020 THEN 'rain_only'
       ELSE 'not_evaluable' END AS "window", count(*) AS n FROM (SELECT year(o_orderdate) + (o_orderkey % 22) AS y FROM orders) GROUP BY ALL""")
def _(t):
    year = F.year("o_orderdate") + F.col("o_orderkey") % 22
    return t.orders.groupBy(big(year).alias("year"), cal.evaluation_window(year).alias("window")).agg(n_rows())


@query("c1_text_normalise")
def _(t):
    return t.documents.groupBy(tx.normalize(F.concat_ws(" ", "source", "text")).alias("norm")).agg(n_rows()).select(
        F.md5("norm").alias("digest"), F.length("norm").alias("length"), "n")


@query("c1_text_squeeze", """
SELECT doc_id, upper(replace(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), 'ß', 'SS')) AS norm FROM documents""")
def _(t):
    return t.documents.select("doc_id", tx.normalize(F.col("text"), fold=False).alias("norm"))


TOKENS = """list_filter(regexp_split_to_array(regexp_replace({0}, '["''()]', ' ', 'g'), '[^A-Z0-9]+'),
  lambda w: w <> '' AND w NOT IN ('TYPHOON','TROPICAL','STORM','CYCLONE','DEPRESSION','SEVERE','SUPER') AND (length(w) > 1 OR regexp_matches(w, '^[0-9]$')))"""
SIZED = "'Super Typhoon \"' || p_name || '\" (' || p_size || ') a ' || p_type"


@query("c2_name_tokens", f"""
SELECT p_partkey, array_to_string({TOKENS.format("upper(" + SIZED + ")")}, ' ') AS tokens FROM part""")
def _(t):
    text = F.concat(F.lit('Super Typhoon "'), "p_name", F.lit('" ('), F.col("p_size").cast("string"), F.lit(") a "), "p_type")
    return t.part.select("p_partkey", F.array_join(tx.tokens(tx.normalize(text)), " ").alias("tokens"))


@query("c3_alias_tokens", """
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'HAIYAN' WHEN p_size % 3 = 1 THEN 'UTOR' ELSE '' END
       || CASE WHEN p_size % 3 < 2 THEN ' ' ELSE '' END || upper(p_name) AS tokens FROM part""")
def _(t):
    alias = F.when(F.col("p_size") % 3 == 0, "Yolanda").when(F.col("p_size") % 3 == 1, "Labuyo").otherwise("Topical Typhoonn")
    words = tx.canonical(tx.tokens(tx.normalize(F.concat_ws(" ", alias, "p_name"))))
    return t.part.select("p_partkey", F.array_join(words, " ").alias("tokens"))


NAME_PAIRS = """names AS (SELECT p_name, p_type, count(*) AS n FROM part GROUP BY ALL), pairs AS (
  SELECT a.p_name AS left_name, b.p_name AS right_name, a.n AS n FROM
  (SELECT p_name, sum(n) AS n FROM names GROUP BY 1) a JOIN (SELECT DISTINCT p_name FROM names) b
  ON split_part(a.p_name, ' ', 1) = split_part(b.p_name, ' ', 1) OR split_part(a.p_name, ' ', 2) = split_part(b.p_name, ' ', 2))"""


def name_pairs(t):
    """Distinct part names that share a word: the blocking step before any scoring."""
    names = t.part.groupBy("p_name").agg(n_rows())
    words = names.select(F.col("p_name").alias("left_name"), "n", F.posexplode(F.split("p_name", " ")).alias("at", "word"))
    other = words.select(F.col("left_name").alias("right_name"), "at", "word")
    return words.join(other, ["at", "word"]).select("left_name", "right_name", "n").distinct()


@query("c4_jaccard", f"""WITH {NAME_PAIRS}
SELECT left_name, right_name, CAST(n AS BIGINT) AS n, CASE WHEN left_name = right_name THEN 1.0::DOUBLE ELSE {R('1.0::DOUBLE / 3')} END AS jaccard FROM pairs""")
def _(t):
    scored = name_pairs(t).withColumn("jaccard", tx.jaccard(tx.tokens(F.upper("left_name")), tx.tokens(F.upper("right_name"))))
    return scored.select("left_name", "right_name", "n", rounded("jaccard").alias("jaccard"))


@query("c5_sequence_ratio")
def _(t):
    return name_pairs(t).select("left_name", "right_name", rounded(tx.sequence_ratio("left_name", "right_name")).alias("ratio"))


@query("c6_name_score")
def _(t):
    return name_scores(name_pairs(t), "left_name", "right_name").select(
        "left_name", "right_name", rounded("jaccard").alias("jaccard"), rounded("score").alias("score"))


@query("c7_json_list", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events""")
def _(t):
    e = F.col("event_id")
    text = (F.when(e % 3 == 0, F.concat(F.lit("["), "props", F.lit("]"))).when(e % 3 == 1, F.col("props"))
            .otherwise(F.concat(F.lit("[{"), "props")))
    return t.events.select("event_id", F.get(tx.json_list(text, "array<struct<k:bigint>>"), F.lit(0))["k"].alias("k"))


@query("c8_unit_ids_in_text", """
SELECT s_suppkey, 'CHN.' || s_nationkey || '_1' AS gid FROM supplier
UNION ALL SELECT s_suppkey, 'CHN.' || s_nationkey || '.' || s_suppkey || '_1' FROM supplier WHERE s_nationkey % 2 = 0
UNION ALL SELECT s_suppkey, 'CHN.' || s_nationkey FROM supplier WHERE s_nationkey % 2 = 0""")
def _(t):
    coarse = F.concat(F.lit("CHN."), F.col("s_nationkey").cast("string"), F.lit("_1"))
    fine = F.concat(F.lit("CHN."), F.col("s_nationkey").cast("string"), F.lit("."), F.col("s_suppkey").cast("string"), F.lit("_1"))
    text = F.concat_ws("; ", F.concat(F.lit("units "), coarse), F.when(F.col("s_nationkey") % 2 == 0, fine))
    return t.supplier.select("s_suppkey", F.explode(tx.gids_in_text(text)).alias("gid"))


@query("c9_identifier_parsing", """
SELECT o_orderkey, '2013-' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') AS base,
       CASE WHEN o_orderkey % 2 = 0 THEN 'CHN;PHL' ELSE 'PHL' END AS iso, 2 + o_orderkey % 2 AS n_groups,
       'tropical cyclone' AS cause, 'x_' || o_orderkey || '_' AS safe FROM orders""")
def _(t):
    k = F.col("o_orderkey").cast("string")
    base = F.concat(F.lit("DR 2013-"), F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0"), F.lit("-PHL"))
    iso = F.when(F.col("o_orderkey") % 2 == 0, "phl, chn; PHL").otherwise("phl")
    groups = F.when(F.col("o_orderkey") % 2 == 0, "a;;b, ").otherwise("a, b;c")
    return t.orders.select(
        "o_orderkey", tx.disaster_base(base).alias("base"), F.array_join(tx.iso_tokens(iso), ";").alias("iso"),
        big(F.size(tx.split_list(groups))).alias("n_groups"), tx.cause(F.lit(" Tropical   CYCLONE ")).alias("cause"),
        tx.safe_id(F.concat(F.lit("x/ "), k, F.lit("#?"))).alias("safe"))


@query("c10_haversine", f"""WITH {fr.TRACKS}
SELECT event_id, {R('''2 * 6371.0088::DOUBLE * atan2(sqrt(h), sqrt(1.0::DOUBLE - h))''', 4)} AS km FROM (
  SELECT a.event_id, sin(radians(b.center_lat - a.center_lat) / 2) * sin(radians(b.center_lat - a.center_lat) / 2)
    + cos(radians(a.center_lat)) * cos(radians(b.center_lat)) * sin(radians(b.center_lon - a.center_lon) / 2) * sin(radians(b.center_lon - a.center_lon) / 2) AS h
  FROM tracks a JOIN tracks b ON a.storm_id = b.storm_id AND b.step = a.step + 1)""")
def _(t):
    tr = fr.tracks(t)
    b = tr.select("storm_id", (F.col("step") - 1).alias("step"), F.col("center_lat").alias("lat2"), F.col("center_lon").alias("lon2"))
    km = geo.haversine_km(F.col("center_lat"), F.col("center_lon"), F.col("lat2"), F.col("lon2"))
    return tr.join(b, ["storm_id", "step"]).select("event_id", rounded(km, 4).alias("km"))


@query("c11_web_mercator", f"""WITH {fr.POINTS}
SELECT event_id, {R('6378137.0::DOUBLE * radians(center_lon)', 3)} AS x,
       {R('6378137.0::DOUBLE * ln(tan(pi() / 4 + radians(center_lat) / 2))', 3)} AS y FROM points""")
def _(t):
    return fr.points(t).select("event_id", rounded(geo.mercator_x(F.col("center_lon")), 3).alias("x"),
                               rounded(geo.mercator_y(F.col("center_lat")), 3).alias("y"))


@query("c12_hazard_columns", f"""
SELECT event_id, {R('w')} AS wind, {R('pow(greatest(w - 12, 0), 3)', 3)} AS power, {R('"value" / 1000.0::DOUBLE * 1000')} AS rain
FROM (SELECT *, sqrt("value" * "value" + (event_id % 40) * (event_id % 40)) AS w FROM events)""")
def _(t):
    wind = hazard.wind_speed(F.col("value"), (F.col("event_id") % 40).cast("double"))
    return t.events.select("event_id", rounded(wind).alias("wind"), rounded(hazard.wind_power(wind), 3).alias("power"),
                           rounded(hazard.rain_mm(F.col("value") / 1000.0)).alias("rain"))


@query("c13_math_columns", f"""
SELECT event_id, {R('ln(1 + "value")')} AS log1p, {R('exp("value" / 100) - 1')} AS expm1, {R('pow("value", 1.5)')} AS power,
       CASE WHEN event_id % 4 = 0 THEN 0.0::DOUBLE ELSE {R('"value"')} END AS finite FROM events""")
def _(t):
    v = F.col("value")
    return t.events.select(
        "event_id", rounded(F.log1p(v)).alias("log1p"), rounded(F.expm1(v / 100)).alias("expm1"), rounded(F.pow(v, F.lit(1.5))).alias("power"),
        rounded(missing.finite_or_zero(F.when(F.col("event_id") % 4 == 0, float("nan")).otherwise(v))).alias("finite"))


@query("c14_grid_indices", f"""WITH {fr.ANCHORS}
SELECT a.event_id, a."row", a."col", {R('50.0::DOUBLE - (a."row" + 0.5::DOUBLE) * 0.1::DOUBLE')} AS row_lat,
       CAST(least(greatest(round_even((90 - center_lat) / 0.25::DOUBLE, 0), 0), 720) AS BIGINT) AS near_i,
       CAST(least(round_even(center_lon / 0.25::DOUBLE, 0), 1439) AS BIGINT) AS near_j
FROM anchors a JOIN points p ON a.event_id = p.event_id""")
def _(t):
    lat, lon = F.col("center_lat"), F.col("center_lon")
    i, j = nearest_index(lat, lon)
    placed = fr.points(t).withColumn("row", fr.TRACK_GRID.row(lat)).withColumn("col", fr.TRACK_GRID.col(lon))
    return placed.select("event_id", "row", "col", rounded(fr.TRACK_GRID.lat(F.col("row"))).alias("row_lat"), i.alias("near_i"), j.alias("near_j"))


@query("c15_safe_ratio", f"""
SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN {R('c_custkey / c_acctbal')} END AS ratio FROM customer""")
def _(t):
    return t.customer.select("c_custkey", rounded(missing.safe_ratio(F.col("c_custkey"), F.col("c_acctbal"))).alias("ratio"))


@query("c16_days_in_year", """
SELECT CAST(year(o_orderdate) AS BIGINT) AS "year", CAST(dayofyear(make_date(year(o_orderdate), 12, 31)) AS BIGINT) AS days, count(*) AS n FROM orders GROUP BY 1, 2""")
def _(t):
    year = F.year("o_orderdate")
    return t.orders.groupBy(big(year).alias("year"), big(cal.days_in_year(year)).alias("days")).agg(n_rows())


@query("c17_worst_status", """
SELECT l_shipmode_year AS "year", CASE max(r) WHEN 1 THEN 'PASS' WHEN 2 THEN 'WARN' ELSE 'FAIL' END AS worst,
       CASE WHEN count(*) FILTER (r = 3) > 0 THEN 'FAIL' WHEN count(*) FILTER (r = 2) > 0 THEN 'WARN' ELSE 'PASS' END AS combined
FROM (SELECT CAST(year(l_shipdate) AS BIGINT) * 100 + month(l_shipdate) AS l_shipmode_year,
             CASE WHEN l_extendedprice > 104000 THEN 3 WHEN l_extendedprice > 100000 THEN 2 ELSE 1 END AS r FROM lineitem) GROUP BY 1""")
def _(t):
    status = st.above(F.col("l_extendedprice"), 104000.0, 100000.0)
    marked = t.lineitem.select(big(F.year("l_shipdate") * 100 + F.month("l_shipdate")).alias("year"), status.alias("status"))
    return marked.groupBy("year").agg(
        st.worst(F.col("status")).alias("worst"),
        st.from_counts(F.count_if(F.col("status") == "FAIL"), F.count_if(F.col("status") == "WARN")).alias("combined"))


@query("c18_sampled_digest", """
SELECT doc_id, sha256(length(t)::VARCHAR || t[1:64] || CASE WHEN length(t) > 128 THEN t[length(t) // 2 - 31:length(t) // 2 + 32] ELSE '' END || CASE WHEN length(t) > 64 THEN t[length(t) - 63:] ELSE '' END) AS digest
FROM (SELECT doc_id, regexp_replace(text, '[^ -~]', '', 'g') AS t FROM documents)""")
def _(t):
    content = F.regexp_replace("text", "[^ -~]", "").cast("binary")
    return t.documents.select("doc_id", sampled_digest(F.octet_length(content), content, 64).alias("digest"))


@query("c18_file_digests")
def _(t):
    """Digests of the given tables' own files, of which three ranges each are read."""
    files = readers.list_files(t.spark, t.folder, "*.parquet")
    got = readers.sampled_digests(files, 1 << 16)
    return got.select(F.regexp_replace("path", "^.*/(?=[^/]+/[^/]+$)", "").alias("path"), "length", "bytes_read", "digest")


@query("c19_date_parts", """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS "day", CAST(unnest(generate_series(CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) + CAST(o_orderkey % 4 AS INTEGER), INTERVAL 1 DAY)) AS DATE) AS spread FROM orders""")
def _(t):
    parts = F.make_date(F.year("o_orderdate"), F.month("o_orderdate"), F.dayofmonth("o_orderdate"))
    return t.orders.select("o_orderkey", parts.alias("day")).withColumn(
        "spread", F.explode(F.sequence("day", F.date_add("day", (F.col("o_orderkey") % 4).cast("int")))))
