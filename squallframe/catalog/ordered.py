"""Ordered operators, samples and set operations (W, T and U rows of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..functions.hazard import sigmoid
from ..operators import external, fit, interp, keyed, matching, panel, raster, stats, tracks, windows
from ..sources.readers import spliced_series
from . import frames as fr
from .aggregates import WINDOW_EVENTS, _rounded, window_events
from .base import R, big, n_rows, query, rounded, scratch_table


@query("w1_storm_steps", f"""WITH {fr.TRACKS} SELECT event_id, storm_id, step FROM tracks""")
def _(t):
    return fr.tracks(t).select("event_id", "storm_id", "step")


@query("w2_zone_numbers", """
SELECT p_partkey, p_name, CAST(dense_rank() OVER (ORDER BY p_name) AS BIGINT) AS country_id FROM part""")
def _(t):
    return panel.number_zones(t.part.select("p_partkey", "p_name"), "p_name").select("p_partkey", "p_name", big("country_id").alias("country_id"))


@query("w3_running_maximum", f"""WITH {fr.YEARLY}
SELECT cell, CAST("year" AS BIGINT) AS "year", {R('least(greatest(max("value") OVER (PARTITION BY cell ORDER BY "year"), 0), 63)')} AS corrected FROM yearly""")
def _(t):
    got = raster.running_maximum(fr.yearly(t), ["cell"], "year", "value")
    return got.select("cell", big("year").alias("year"), rounded("corrected").alias("corrected"))


@query("w3_temporal_blend", f"""WITH RECURSIVE {fr.YEARLY}, s AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY "year") AS k FROM yearly),
r AS (SELECT cell, "year", k, least(greatest("value", 0), 63) AS c, FALSE AS changed FROM s WHERE k = 1
  UNION ALL SELECT s.cell, s."year", s.k, least(greatest(CASE WHEN s."value" + 2.0::DOUBLE < r.c THEN s."value" + 0.5::DOUBLE * (r.c - s."value") ELSE s."value" END, 0), 63),
         s."value" + 2.0::DOUBLE < r.c FROM r JOIN s ON s.cell = r.cell AND s.k = r.k + 1)
SELECT cell, CAST("year" AS BIGINT) AS "year", {R('c')} AS corrected, changed FROM r""")
def _(t):
    got = raster.non_decreasing(fr.yearly(t), ["cell"], "year", "value", tolerance=2.0, blend=0.5)
    return got.select("cell", big("year").alias("year"), rounded("corrected").alias("corrected"), "changed")


@query("w3_incremental_years", f"""WITH RECURSIVE {fr.YEARLY}, s AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY "year") AS k FROM yearly),
r AS (SELECT cell, "year", k, least(greatest("value", 0), 63) AS c, FALSE AS changed FROM s WHERE k = 1
  UNION ALL SELECT s.cell, s."year", s.k, least(greatest(CASE WHEN s."value" + 2.0::DOUBLE < r.c THEN s."value" + 0.5::DOUBLE * (r.c - s."value") ELSE s."value" END, 0), 63),
         s."value" + 2.0::DOUBLE < r.c FROM r JOIN s ON s.cell = r.cell AND s.k = r.k + 1)
SELECT cell, CAST("year" AS BIGINT) AS "year", {R('c')} AS corrected, changed FROM r""")
def _(t):
    """The first years are folded at once, each later one is added to the stored state of the years before it."""
    series, first, rule = fr.yearly(t), 1996, {"tolerance": 2.0, "blend": 0.5}
    folded = raster.non_decreasing(series.filter(F.col("year") <= first), ["cell"], "year", "value", **rule)
    out = folded.select("cell", "year", "corrected", "changed")
    state = folded.groupBy("cell").agg(F.max_by("corrected", "year").alias("last"))
    for year in sorted(r[0] for r in series.select("year").filter(F.col("year") > first).distinct().collect()):
        name = scratch_table(t, f"w3_state_{year}")
        state.write.saveAsTable(name)
        added, state = raster.corrected_year(t.spark.table(name), series.filter(F.col("year") == year), ["cell"], "value", **rule)
        out = out.unionByName(added.select("cell", F.lit(year).alias("year"), "corrected", "changed"))
    return out.select("cell", big("year").alias("year"), rounded("corrected").alias("corrected"), "changed")


@query("w4_drift_flags", f"""WITH {fr.YEARLY},
z AS (SELECT cell, "year", ("value" - avg("value") OVER w) / nullif(stddev_pop("value") OVER w, 0) AS z FROM yearly WINDOW w AS (PARTITION BY cell))
SELECT cell, CAST("year" AS BIGINT) AS "year", {R('coalesce(z, 0)')} AS z_score, CAST(abs(coalesce(z, 0)) > 1.5 AS BIGINT) AS flagged FROM z""")
def _(t):
    got = stats.sigma_flags(fr.yearly(t), ["cell"], "value", 1.5, order="year")
    return got.select("cell", big("year").alias("year"), rounded("z_score").alias("z_score"), big("flagged").alias("flagged"))


@query("w5_upper_flags", f"""
WITH f AS (SELECT year(o_orderdate) * 100 + month(o_orderdate) AS m, o_orderstatus AS s, avg(CAST(o_orderpriority LIKE '1%' AS INTEGER)) AS r FROM orders GROUP BY ALL)
SELECT CAST(m AS BIGINT) AS m, s, {R('r')} AS fill_ratio, CAST((r - avg(r) OVER w) / stddev_pop(r) OVER w > 2 AS BIGINT) AS flagged FROM f WINDOW w AS (PARTITION BY s)""")
def _(t):
    ratio = t.orders.groupBy(big(F.year("o_orderdate") * 100 + F.month("o_orderdate")).alias("m"), F.col("o_orderstatus").alias("s")).agg(
        F.avg(F.col("o_orderpriority").startswith("1").cast("double")).alias("fill_ratio"))
    got = stats.sigma_flags(ratio, ["s"], "fill_ratio", 2.0, upper_only=True)
    return got.select("m", "s", rounded("fill_ratio").alias("fill_ratio"), big("flagged").alias("flagged"))


@query("w6_compound_hazard", f"""WITH {fr.GRID},
n AS (SELECT *, min("value") OVER w AS v0, max("value") OVER w AS v1, min(r) OVER w AS r0, max(r) OVER w AS r1 FROM (SELECT *, CASE WHEN "row" % 6 = 0 THEN 1.0::DOUBLE ELSE signed END AS r FROM grid) WINDOW w AS (PARTITION BY "row"))
SELECT "row", "col", {R('0.5::DOUBLE * CASE WHEN v1 > v0 THEN ("value" - v0) / (v1 - v0) ELSE 0 END + 0.5::DOUBLE * CASE WHEN r1 > r0 THEN (r - r0) / (r1 - r0) ELSE 0 END')} AS hazard FROM n""")
def _(t):
    cells = fr.grid(t).withColumn("r", F.when(F.col("row") % 6 == 0, 1.0).otherwise(F.col("signed")))
    got = windows.compound_hazard(cells, "value", "r", ["row"])
    return got.select("row", "col", rounded("hazard_compound").alias("hazard"))


TOP = """m AS (SELECT *, coalesce({a} >= quantile_cont({a}, 0.9) OVER w, FALSE) AS ta, coalesce({b} >= quantile_cont({b}, 0.9) OVER w, FALSE) AS tb
  FROM (SELECT "row", "value" AS v, CASE WHEN "col" % 7 <> 3 THEN signed END AS s, CASE WHEN "col" % 7 <> 3 THEN "value" END AS pv FROM grid) WINDOW w AS (PARTITION BY "row"))"""


@query("w7_top_share_paired", f"""WITH {fr.GRID}, {TOP.format(a='pv', b='s')}
SELECT "row", count(*) FILTER (ta AND tb) AS n_both, {R('count(*) FILTER (ta AND tb) / count(*) FILTER (ta OR tb)')} AS iou, {R('count(*) FILTER (ta AND tb) / count(*) FILTER (ta)')} AS recall FROM m GROUP BY 1""")
def _(t):
    cells = fr.grid(t).withColumn("s", F.when(F.col("col") % 7 != 3, F.col("signed")))
    return _rounded(stats.mask_overlap(stats.top_share_masks(cells, ["row"], "value", "s"), ["row"]))


@query("w7_top_share_independent", f"""WITH {fr.GRID}, {TOP.format(a='v', b='s')}
SELECT "row", count(*) FILTER (ta AND tb) AS n_both, {R('count(*) FILTER (ta AND tb) / count(*) FILTER (ta OR tb)')} AS iou, {R('count(*) FILTER (ta AND tb) / count(*) FILTER (ta)')} AS recall FROM m GROUP BY 1""")
def _(t):
    cells = fr.grid(t).withColumn("s", F.when(F.col("col") % 7 != 3, F.col("signed")))
    return _rounded(stats.mask_overlap(stats.top_share_masks(cells, ["row"], "value", "s", paired=False), ["row"]))


EVENT_CELLS = """cells AS (SELECT "row" AS step, "col" // 8 AS wi, "col" % 8 AS wj, CASE WHEN "row" % 17 <> 0 THEN "value" END AS hazard, CASE WHEN signed > 0.2 AND "row" % 34 <> 0 THEN signed ELSE 0 END AS loss FROM grid),
q AS (SELECT *, quantile_cont(hazard, 0.9) OVER (PARTITION BY step) AS q90, count(hazard) OVER (PARTITION BY step) AS k FROM cells),
keep AS (SELECT *, CASE WHEN k > 0 THEN hazard >= q90 OR (loss > 0 AND hazard IS NOT NULL) ELSE loss > 0 END AS kept FROM q),
chosen AS (SELECT * FROM keep WHERE kept UNION ALL
  SELECT * FROM keep WHERE k = 0 AND wi = 4 AND wj = 4 AND step NOT IN (SELECT step FROM keep WHERE kept))"""


def event_cells(t):
    r, c = F.col("row"), F.col("col")
    return fr.grid(t).select(
        r.alias("step"), F.floor(c / 8).alias("wi"), (c % 8).alias("wj"), F.when(r % 17 != 0, F.col("value")).alias("hazard"),
        F.when((F.col("signed") > 0.2) & (r % 34 != 0), F.col("signed")).otherwise(F.lit(0.0)).alias("loss"))


@query("w8_event_points", f"""WITH {fr.GRID}, {EVENT_CELLS}
SELECT step, CAST(wi AS BIGINT) AS wi, CAST(wj AS BIGINT) AS wj, {R('hazard')} AS hazard FROM chosen""")
def _(t):
    got = tracks.event_points(event_cells(t), ["step"], "hazard", "loss", "wi", "wj", 8)
    return got.select("step", "wi", "wj", rounded("hazard").alias("hazard"))


@query("w9_point_classes", f"""WITH {fr.GRID}, {EVENT_CELLS}
SELECT CASE WHEN hazard >= q90 AND loss > 0 THEN 'overlap' WHEN loss > 0 THEN 'loss_only' ELSE 'hazard_only' END AS point_class, count(*) AS n FROM chosen GROUP BY 1""")
def _(t):
    return tracks.event_points(event_cells(t), ["step"], "hazard", "loss", "wi", "wj", 8).groupBy("point_class").agg(n_rows())


@query("w10_candidate_grades", f"""
WITH c AS (SELECT l_orderkey AS rec_id, l_suppkey AS storm, max(l_discount) * 10 AS score, CAST(sum(l_quantity) AS BIGINT) AS overlap FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY score DESC, overlap DESC, storm) AS rn FROM c),
s AS (SELECT *, max(score) OVER w AS s1, coalesce(max(CASE WHEN rn = 2 THEN score END) OVER w, 0) AS s2, count(*) OVER w AS k FROM r WINDOW w AS (PARTITION BY rec_id)),
f AS (SELECT *, sum(CAST(score >= greatest(0.6::DOUBLE, s1 - 0.1::DOUBLE) AS INTEGER)) OVER (PARTITION BY rec_id) AS close_n, s1 >= 0.8::DOUBLE AND (k = 1 OR s1 - s2 >= 0.15::DOUBLE) AS clear FROM s)
SELECT rec_id, storm, rn AS "rank", CASE WHEN clear THEN 'A' WHEN s1 >= 0.6::DOUBLE THEN CASE WHEN close_n = 1 THEN 'A' ELSE 'B' END ELSE 'C' END AS grade,
       CASE WHEN clear THEN rn = 1 WHEN s1 >= 0.6::DOUBLE THEN score >= greatest(0.6::DOUBLE, s1 - 0.1::DOUBLE) ELSE TRUE END AS selected FROM f""")
def _(t):
    c = t.lineitem.groupBy(F.col("l_orderkey").alias("rec_id"), F.col("l_suppkey").alias("storm")).agg(
        (F.max("l_discount") * 10).alias("score"), big(F.sum("l_quantity")).alias("overlap"))
    got = matching.grade_candidates(c, "rec_id", tie="storm")
    return got.select("rec_id", "storm", big("rank").alias("rank"), "grade", "selected")


@query("w11_case_ranking", f"""
SELECT o_orderkey, {R('o_totalprice', 2)} AS loss, row_number() OVER (ORDER BY o_totalprice DESC, strpos('OFP', o_orderstatus), o_orderkey) AS case_rank FROM orders
QUALIFY case_rank <= 9""")
def _(t):
    graded = t.orders.withColumn("grade", F.translate("o_orderstatus", "OFP", "ABC"))
    got = external.rank_cases(graded, "o_totalprice", "grade", "o_orderkey", 9)
    return got.select("o_orderkey", rounded("o_totalprice", 2).alias("loss"), big("case_rank").alias("case_rank"))


@query("w12_peak_lag", f"""WITH {WINDOW_EVENTS}, d AS (SELECT event, "day", sum(ours) AS ours, sum(theirs) AS theirs FROM dm GROUP BY 1, 2),
a AS (SELECT event, "day" FROM d QUALIFY row_number() OVER (PARTITION BY event ORDER BY ours DESC, "day") = 1),
b AS (SELECT event, "day" FROM d QUALIFY row_number() OVER (PARTITION BY event ORDER BY theirs DESC, "day") = 1)
SELECT event, a."day" AS peak_ours, b."day" AS peak_theirs, CAST(a."day" - b."day" AS BIGINT) AS peak_lag FROM a JOIN b USING (event)""")
def _(t):
    means = external.event_day_means(window_events(t), "event", "day", ["ours", "theirs"], "step")
    got = external.rain_agreement(means, "event", "day", "ours", "theirs")
    return got.select("event", "peak_ours", "peak_theirs", big("peak_lag").alias("peak_lag"))


@query("w13_step_peaks", f"""WITH {fr.POINTS}
SELECT storm_id, CAST(hour(ts) AS BIGINT) AS step, obs_date, {R('max(wind_kt)')} AS peak FROM points WHERE obs_date BETWEEN DATE '2024-01-08' AND DATE '2024-01-22' GROUP BY ALL""")
def _(t):
    p = fr.points(t).withColumn("step", big(F.hour("ts")))
    got = tracks.step_peaks(p, "storm_id", "step", "wind_kt", "obs_date", F.lit("2024-01-08").cast("date"), F.lit("2024-01-22").cast("date"))
    return _rounded(got)


@query("w14_keep_first", f"""
SELECT c_nationkey, c_mktsegment, c_custkey, {R('c_acctbal', 2)} AS c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal DESC, c_custkey) = 1""")
def _(t):
    got = keyed.first_per_key(t.customer, ["c_nationkey", "c_mktsegment"], [F.col("c_acctbal").desc(), F.col("c_custkey")])
    return got.select("c_nationkey", "c_mktsegment", "c_custkey", rounded("c_acctbal", 2).alias("c_acctbal"))


@query("w15_preferred_name", """
SELECT c_nationkey, c_name FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY CAST(c_acctbal < 9000 AS INTEGER), c_custkey) = 1""")
def _(t):
    df = t.customer.withColumn("is_disputed", (F.col("c_acctbal") < 9000).cast("int"))
    return panel.preferred_name(df, "c_nationkey", "c_name", "is_disputed", "c_custkey")


@query("w16_distinct_track", f"""WITH {fr.TRACKS},
f AS (SELECT storm_id, floor(center_lon) AS lon, floor(center_lat) AS lat, min(step) AS step FROM tracks GROUP BY ALL)
SELECT storm_id, CAST(lon AS BIGINT) AS lon, CAST(lat AS BIGINT) AS lat, step, row_number() OVER (PARTITION BY storm_id ORDER BY step) AS point_no FROM f""")
def _(t):
    p = fr.tracks(t).withColumn("lon", F.floor("center_lon")).withColumn("lat", F.floor("center_lat"))
    return tracks.distinct_track(p, "storm_id", "lon", "lat", "step").select("storm_id", "lon", "lat", "step", "point_no")


KERNEL = ", ".join(f"({k - 5}, {w!r}::DOUBLE)" for k, w in enumerate(raster.gaussian_kernel(1.2)))
REFLECT = "CASE WHEN {i} < 0 THEN -({i}) - 1 WHEN {i} >= {n} THEN 2 * {n} - 1 - ({i}) ELSE {i} END"


@query("w17_gaussian_blur", f"""WITH {fr.GRID}, kernel(k, w) AS (VALUES {KERNEL}), size AS (SELECT max("row") + 1 AS nr, max("col") + 1 AS nc FROM grid),
a AS (SELECT t."row", t."col", sum(s."value" * w) AS v FROM grid t, kernel, size, grid s WHERE s."row" = t."row" AND s."col" = {REFLECT.format(i='(t."col" + k)', n='nc')} GROUP BY 1, 2)
SELECT t."row", t."col", {R('sum(s.v * w)', 5)} AS "value" FROM a t, kernel, size, a s WHERE s."col" = t."col" AND s."row" = {REFLECT.format(i='(t."row" + k)', n='nr')} GROUP BY 1, 2""")
def _(t):
    g = fr.grid(t)
    sized = keyed.with_scalars(g, g.agg((F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).alias("n_cols")))
    return _rounded(raster.gaussian_blur(sized, F.col("n_rows"), F.col("n_cols")), 5)


KNOTS = [1996, 1997, 1998, 1999, 2000]
_D = [f"(y{i + 1} - y{i})" for i in range(4)]
_IN = [f"CASE WHEN d{i - 1} * d{i} <= 0 THEN 0 ELSE 6 / (3 / d{i - 1} + 3 / d{i}) END" for i in range(1, 4)]
_END = "CASE WHEN sign((3 * {a} - {b}) / 2) <> sign({a}) THEN 0 WHEN sign({a}) <> sign({b}) AND abs((3 * {a} - {b}) / 2) > 3 * abs({a}) THEN 3 * {a} ELSE (3 * {a} - {b}) / 2 END"
_M = [_END.format(a="d0", b="d1"), *_IN, _END.format(a="d3", b="d2")]
_HERMITE = "(2*t*t*t - 3*t*t + 1) * {y0} + (t*t*t - 2*t*t + t) * {m0} + (3*t*t - 2*t*t*t) * {y1} + (t*t*t - t*t) * {m1}"
_PIECES = "CASE k " + " ".join(f"WHEN {k} THEN " + _HERMITE.format(y0=f"y{k}", m0=f"m{k}", y1=f"y{k + 1}", m1=f"m{k + 1}") for k in range(4)) + " END"
_Y = ", ".join('ln(1 + greatest(coalesce(max(CASE WHEN "year" = %d THEN "value" END), 0), 0)) AS y%d' % (k, i) for i, k in enumerate(KNOTS))


@query("w18_log_pchip", f"""WITH {fr.YEARLY}, w AS (SELECT cell, {_Y} FROM yearly WHERE "year" BETWEEN 1996 AND 2000 GROUP BY 1),
d AS (SELECT *, {', '.join(f'{d} AS d{i}' for i, d in enumerate(_D))} FROM w), m AS (SELECT *, {', '.join(f'{m} AS m{i}' for i, m in enumerate(_M))} FROM d),
p AS (SELECT *, least(y - 1996, 3) AS k, CAST(y - 1996 - least(y - 1996, 3) AS DOUBLE) AS t FROM m, range(1996, 2003) AS r(y))
SELECT cell, CAST(y AS BIGINT) AS "year", {R(f'ln(1 + greatest(exp({_PIECES}) - 1, 0))')} AS log_value FROM p""")
def _(t):
    series = fr.yearly(t).filter(F.col("year").isin(KNOTS))
    got = interp.log_pchip(series, ["cell"], "year", "value", KNOTS, 1996, 2002)
    return got.select("cell", big("year").alias("year"), rounded(F.log1p("value")).alias("log_value"))


@query("w19_sigmoid_fit", f"""
SELECT 4.0::DOUBLE AS a, 50.0::DOUBLE AS b, -0.9::DOUBLE AS c, 9.0::DOUBLE AS d, 1.0::DOUBLE AS r2, count(*) AS n FROM lineitem""")
def _(t):
    """A curve planted in the line items is recovered from all of them."""
    x = F.col("l_quantity") / 2.5
    sample = t.lineitem.select(x.alias("x"), sigmoid(x, 4.0, 50.0, -0.9, 9.0).alias("y"))
    got = fit.fit_sigmoid(sample)
    return t.region.filter("r_regionkey = 0").select(
        *[rounded(F.lit(v), 3).alias(n) for n, v in zip("abcd", got.params)], rounded(F.lit(got.r2), 3).alias("r2"), big(F.lit(got.n)).alias("n"))


@query("w19_fit_by_year", f"""
WITH s AS (SELECT CAST(year(l_shipdate) AS VARCHAR) AS scope, 4.0::DOUBLE + 50.0::DOUBLE / (1 + exp(-0.9::DOUBLE * (l_quantity / 2.5::DOUBLE - 9.0::DOUBLE))) AS f,
                  l_discount * 20 + (year(l_shipdate) - 1990) * 0.1::DOUBLE AS e FROM lineitem),
a AS (SELECT scope, f, e FROM s UNION ALL SELECT 'combined', f, e FROM s)
SELECT scope, 4.0::DOUBLE AS a, 50.0::DOUBLE AS b, -0.9::DOUBLE AS c, 9.0::DOUBLE AS d, 2 * count(*) AS n, {R('sqrt(avg(e * e))', 4)} AS rmse, {R('avg(abs(e))', 4)} AS mae,
       {R('1 - avg(e * e) / (var_pop(f) + avg(e * e))', 4)} AS r2, TRUE AS stationary FROM a GROUP BY 1""")
def _(t):
    """Every line item stands once above and once below a planted curve, by an error that differs with the year: the
    least squares of each year and of all years are known, and the fits have residuals."""
    x, year = F.col("l_quantity") / 2.5, F.year("l_shipdate")
    error = F.col("l_discount") * 20 + (year - 1990) * 0.1
    sample = t.lineitem.select(year.alias("year"), x.alias("x"), F.explode(F.array(error, -error)).alias("e"))
    got = fit.fit_sigmoid_scopes(sample.withColumn("y", sigmoid(F.col("x"), 4.0, 50.0, -0.9, 9.0) + F.col("e")), "year")
    return got.select("scope", *[rounded(c, 3).alias(c) for c in "abcd"], "n", *[rounded(c, 4).alias(c) for c in ("rmse", "mae", "r2")],
                      (F.col("gradient") < 1e-4).alias("stationary"))


@query("w20_apply_curve", f"""WITH {fr.GRID}
SELECT "row", "col", {R('least(greatest(6.5::DOUBLE + 57.4::DOUBLE / (1 + exp(-1.9::DOUBLE * ("value" - 10.8::DOUBLE))), 0), 63)')} AS dn FROM grid""")
def _(t):
    return fit.apply_sigmoid(fr.grid(t), "value", fit.START).select("row", "col", rounded("dn").alias("dn"))


@query("w21_bilinear_sample", f"""WITH {fr.DAILY}, v AS (SELECT * FROM daily WHERE var = 'view'),
f AS (SELECT event_id, obs_date, center_lon - 100.0::DOUBLE AS fx, (least(greatest(center_lat, 5), 49.5) - 5.0::DOUBLE) / 0.5::DOUBLE AS fy FROM points),
g AS (SELECT *, CAST(floor(fx) AS BIGINT) AS i, CAST(least(greatest(floor(fy), 0), 88) AS BIGINT) AS j FROM f),
c AS (SELECT *, (i + di) % 80 AS ci, j + dj AS cj, (CASE di WHEN 0 THEN 1 - (fx - i) ELSE fx - i END) * (CASE dj WHEN 0 THEN 1 - (fy - j) ELSE fy - j END) AS w FROM g, range(2) AS a(di), range(2) AS b(dj))
SELECT event_id, {R('CASE WHEN sum(CASE WHEN v."value" IS NOT NULL THEN w END) > 0 THEN sum(w * v."value") / sum(CASE WHEN v."value" IS NOT NULL THEN w END) END', 4)} AS rain
FROM c LEFT JOIN v ON v."day" = obs_date AND lat_idx = cj AND lon_idx = ci GROUP BY 1""")
def _(t):
    grid = fr.daily(t).filter("var = 'view'").select("day", F.col("lon_idx").alias("i_lon"), F.col("lat_idx").alias("j_lat"), F.col("value").alias("rain"))
    pts = fr.points(t).withColumn("day", F.col("obs_date"))
    got = windows.bilinear_sample(pts, grid, "center_lat", "center_lon", (fr.LAT0, 0.5, 90), (fr.LON0, 1.0, 80), ["day"], ["event_id"], ["rain"])
    return got.select("event_id", rounded("rain", 4).alias("rain"))


@query("t1_sorted_output", f"""SELECT n_name, r_name, row_number() OVER (ORDER BY r_name, n_name DESC) AS pos FROM nation JOIN region ON n_regionkey = r_regionkey""")
def _(t):
    joined = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    order = [F.col("r_name"), F.col("n_name").desc()]
    return keyed.rank_rows(joined, [], order, F.col("r_name"), "pos").select("n_name", "r_name", "pos").orderBy("pos")


@query("t2_top_per_case", f"""
SELECT l_suppkey, l_orderkey, l_linenumber, {R('l_extendedprice', 2)} AS price FROM (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS rn FROM lineitem) WHERE rn <= 10""")
def _(t):
    got = keyed.first_per_key(t.lineitem, ["l_suppkey"], [F.col("l_extendedprice").desc(), *map(F.col, ("l_orderkey", "l_linenumber", "l_partkey"))], 10)
    return got.select("l_suppkey", "l_orderkey", "l_linenumber", rounded("l_extendedprice", 2).alias("price"))


@query("t3_head", f"""SELECT o_orderkey, {R('o_totalprice', 2)} AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20""")
def _(t):
    return t.orders.orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(20).select("o_orderkey", rounded("o_totalprice", 2).alias("price"))


@query("t4_seeded_sample", """
SELECT CAST("year" AS BIGINT) AS "year", o_orderkey FROM (SELECT year(o_orderdate) AS "year", o_orderkey,
  row_number() OVER (PARTITION BY year(o_orderdate) ORDER BY md5('20260304:' || o_orderkey), o_orderkey) AS rn FROM orders) WHERE rn <= 300""")
def _(t):
    df = t.orders.select(big(F.year("o_orderdate")).alias("year"), "o_orderkey")
    return keyed.hash_sample(df, ["year"], ["o_orderkey"], 300, 20260304)


@query("t5_strided_sample", f"""WITH {fr.GRID} SELECT "row", "col", {R('"value"')} AS "value" FROM grid WHERE "row" % 8 = 0 AND "col" % 8 = 0""")
def _(t):
    return fr.grid(t).filter("row % 8 = 0 and col % 8 = 0").select("row", "col", rounded("value").alias("value"))


@query("t6_region_crop", f"""WITH {fr.GRID} SELECT zone, count(*) AS n, {R('sum("value")', 4)} AS total FROM grid
WHERE "row" BETWEEN 50 AND 399 AND "col" BETWEEN 8 AND 47 GROUP BY 1""")
def _(t):
    spec = geo.GridSpec(50.0, 100.0, 0.1, 1.25)
    bounds = t.region.filter("r_regionkey = 0").select(
        spec.row(F.lit(44.95)).alias("r0"), spec.row(F.lit(10.05)).alias("r1"), spec.col(F.lit(110.0)).alias("c0"), spec.col(F.lit(159.9)).alias("c1"))
    crop = keyed.with_scalars(fr.grid(t), bounds).filter("row between r0 and r1 and col between c0 and c1")
    return _rounded(crop.groupBy("zone").agg(n_rows(), F.sum("value").alias("total")), 4)


@query("u1_union_by_name", """
SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance, NULL::VARCHAR AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, NULL, c_mktsegment FROM customer""")
def _(t):
    a = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    b = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return a.unionByName(b, allowMissingColumns=True)


@query("u2_set_difference", "SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag <> 'R'")
def _(t):
    pairs = t.lineitem.select("l_partkey", "l_suppkey", "l_returnflag")
    returned = pairs.filter("l_returnflag = 'R'").drop("l_returnflag")
    return returned.distinct().join(pairs.filter("l_returnflag <> 'R'").drop("l_returnflag").distinct(), ["l_partkey", "l_suppkey"], "left_anti")


@query("u3_set_intersection", "SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A'")
def _(t):
    pairs = t.lineitem.select("l_partkey", "l_suppkey", "l_returnflag")
    return pairs.filter("l_returnflag = 'R'").drop("l_returnflag").intersect(pairs.filter("l_returnflag = 'A'").drop("l_returnflag"))


@query("u4_distinct_by_subset", """
SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2""")
def _(t):
    got = keyed.first_per_key(t.lineitem, ["l_orderkey", "l_linenumber"], [F.col("l_partkey")])
    return got.select("l_orderkey", "l_linenumber", "l_partkey")


@query("u5_spliced_series", f"""WITH {fr.YEARLY}
SELECT CAST(y AS BIGINT) AS "year", CASE WHEN cell IS NULL THEN 'missing' WHEN y <= 1998 THEN 'early' ELSE 'late' END AS method, count(cell) AS n
FROM range(1990, 2004) AS r(y) LEFT JOIN yearly ON "year" = y AND (y <= 1998 OR "value" > 10) GROUP BY 1, 2""")
def _(t):
    series = fr.yearly(t).withColumn("year", big("year"))
    spine = t.spark.range(1990, 2004).withColumnRenamed("id", "year")
    got = spliced_series(series, series.filter("value > 10"), 1998, spine)
    return got.groupBy("year", "method").agg(F.count("cell").alias("n"))


@query("u6_reshape_round_trip", f"""WITH {fr.PANEL}
SELECT k.nation, CAST(y AS BIGINT) AS "year", {R('p.gdp', 2)} AS gdp FROM (SELECT DISTINCT nation FROM panel) k CROSS JOIN range(1994, 2003) AS r(y) LEFT JOIN panel p ON p.nation = k.nation AND p."year" = y""")
def _(t):
    years = list(range(1994, 2003))
    wide = panel.long_to_wide(fr.panel(t), ["nation"], years, "gdp")
    long = panel.wide_to_long(wide, ["nation"], years)
    return long.select("nation", big("year").alias("year"), rounded("gdp", 2).alias("gdp"))
