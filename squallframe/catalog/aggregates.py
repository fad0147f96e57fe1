"""Aggregations (A rows of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import joined_set
from ..operators import allocation as al
from ..operators import external, keyed, raster, spatial, stats, windows
from ..operators.interp import knot_fidelity, log_pchip
from ..operators.matching import same_day_steps
from ..operators.panel import dense_panel, zone_parts
from ..operators.quality import attribution_by_year, attribution_verdict, describe
from ..operators.quantiles import exact_quantiles
from ..operators.tracks import storm_summary
from . import frames as fr
from .base import R, big, n_rows, query, rounded


def _rounded(df, digits=6, **columns):
    return df.withColumns({c: rounded(c, digits) for c in df.columns if dict(df.dtypes)[c] == "double"} | columns)


BLOCK = """SELECT a.event_id, CAST({flip} AS BIGINT) AS wi, CAST(dc // 4 AS BIGINT) AS wj, g."value", g.zone
  FROM anchors a, range(12) AS x(dr), range(12) AS y(dc), grid g WHERE g."row" = a."row" - 6 + dr AND g."col" = a."col" - 6 + dc"""


@query("a1_block_mean", f"""WITH {fr.ANCHORS}, {fr.GRID}
SELECT event_id, wi, wj, {R('avg("value")')} AS "value" FROM ({BLOCK.format(flip='2 - dr // 4')}) GROUP BY ALL""")
def _(t):
    cut = windows.extract_windows(fr.anchors(t), fr.grid(t).select("row", "col", "value"), method="mean", size=3, factor=4)
    return cut.filter("value is not null").select("event_id", big("wi").alias("wi"), big("wj").alias("wj"), rounded("value").alias("value"))


@query("a1_block_sum_unflipped", f"""WITH {fr.ANCHORS}, {fr.GRID}
SELECT event_id, wi, wj, {R('sum("value")', 4)} AS "value" FROM ({BLOCK.format(flip='dr // 4')}) GROUP BY ALL""")
def _(t):
    cut = windows.extract_windows(fr.anchors(t), fr.grid(t).select("row", "col", "value"), size=3, factor=4, flip=False)
    return cut.filter("value is not null").select("event_id", big("wi").alias("wi"), big("wj").alias("wj"), rounded("value", 4).alias("value"))


@query("a2_zone_share", f"""WITH {fr.ANCHORS}, {fr.GRID}
SELECT event_id, wi, wj, {R('count(*) / 16.0::DOUBLE')} AS share FROM ({BLOCK.format(flip='2 - dr // 4')}) WHERE zone = event_id % 10 GROUP BY ALL""")
def _(t):
    anchors = fr.anchors(t).withColumn("target", F.col("event_id") % 10)
    cut = windows.zone_share_windows(anchors, fr.grid(t).select("row", "col", "zone"), size=3, factor=4)
    return cut.filter("share > 0").select("event_id", big("wi").alias("wi"), big("wj").alias("wj"), rounded("share").alias("share"))


@query("a3_zone_weighted_sum", f"""WITH {fr.GRID}
SELECT zone, {R('sum("value" * abs(signed))', 4)} AS total FROM grid WHERE zone > 0 GROUP BY 1""")
def _(t):
    return _rounded(raster.zone_sums(fr.grid(t), F.col("value") * F.abs("signed")), 4)


@query("a4_zone_sum_of_output", f"""WITH {fr.GRID}, z AS (SELECT zone, sum("value") AS w FROM grid WHERE zone > 0 GROUP BY 1)
SELECT zone, {R('sum(100.0::DOUBLE * zone * g."value" / z.w)', 4)} AS total FROM grid g JOIN z USING (zone) GROUP BY 1""")
def _(t):
    g = fr.grid(t)
    totals = g.select("zone").distinct().withColumn("gdp", F.col("zone") * F.lit(100.0))
    spread = raster.disaggregate(g, totals, F.col("value"), "gdp")
    return _rounded(raster.zone_sums(spread, F.col("asset")), 4)


@query("a5_weighted_composite", f"""WITH {fr.MONTHLY}
SELECT cell, CAST("year" AS BIGINT) AS "year", {R('coalesce(sum(CASE WHEN "month" % 5 <> 0 THEN avg_rad * cf_cvg END) / nullif(sum(CASE WHEN "month" % 5 <> 0 THEN cf_cvg END), 0), 0)', 4)} AS "value"
FROM monthly GROUP BY 1, 2""")
def _(t):
    m = fr.monthly(t).withColumn("avg_rad", F.when(F.col("month") % 5 != 0, F.col("avg_rad")))
    got = raster.weighted_composite(m, "avg_rad", "cf_cvg", ["cell", "year"])
    return got.select("cell", big("year").alias("year"), rounded("value", 4).alias("value"))


for method, agg in (("average", 'avg("value")'), ("sum", 'sum("value")'), ("nearest", 'min_by("value", ("d", "row", "col"))')):
    def _resampled(t, method=method):
        return raster.resample(fr.grid(t), 3.0, 5.0, method).select("row", "col", rounded("value", 4).alias("value"))

    query(f"a6_resample_{method}", f"""WITH {fr.GRID}, p AS (
      SELECT *, ("row" + 0.5) / 3.0::DOUBLE AS r, ("col" + 0.5) / 5.0::DOUBLE AS c FROM grid),
    d AS (SELECT CAST(floor(r) AS BIGINT) AS tr, CAST(floor(c) AS BIGINT) AS tc, "row", "col", "value",
                 (r - floor(r) - 0.5) * (r - floor(r) - 0.5) + (c - floor(c) - 0.5) * (c - floor(c) - 0.5) AS d FROM p)
    SELECT tr AS "row", tc AS "col", {R(agg, 4)} AS "value" FROM d GROUP BY 1, 2""")(_resampled)


_MET = """{t} AS (SELECT "row" AS r, "col" AS c, "value" AS v, {i} AS k, least(({x} + 1 - {s}) / {q}, {i} + 1) - greatest(({x} - {s}) / {q}, {i}) AS w
  FROM (SELECT *, unnest(generate_series(CAST(floor(({x} - {s}) / {q}) AS BIGINT), CAST(ceil(({x} + 1 - {s}) / {q}) AS BIGINT) - 1)) AS {i} FROM g))"""
OVERLAP = f"""{fr.GRID}, g AS (SELECT "row", "col", "value" FROM grid WHERE "col" % 7 <> 2),
{_MET.format(t='rw', x='"row"', s='1.4::DOUBLE', q='3.7::DOUBLE', i='tr')},
{_MET.format(t='cw', x='"col"', s='(-0.6)::DOUBLE', q='2.3::DOUBLE', i='tc')},
o AS (SELECT rw.k AS "row", cw.k AS "col", rw.w * 3.7::DOUBLE * cw.w * 2.3::DOUBLE AS w, rw.v AS v FROM rw JOIN cw ON rw.r = cw.r AND rw.c = cw.c WHERE rw.w > 0 AND cw.w > 0)"""

for method, agg in (("average", "sum(w * v) / sum(w)"), ("sum", "sum(w * v)")):
    def _regridded(t, method=method):
        g = fr.grid(t).select("row", "col", F.when(F.col("col") % 7 != 2, F.col("value")).alias("value"))
        got = raster.overlap_resample(g, (3.7, 1.4), (2.3, -0.6), method)
        return got.select("row", "col", rounded("value", 4).alias("value"))

    query(f"a6_overlap_{method}", f"""WITH {OVERLAP} SELECT "row", "col", {R(agg, 4)} AS "value" FROM o GROUP BY 1, 2""")(_regridded)


@query("a6_mosaic", f"""WITH {fr.GRID}, f AS (SELECT 'b' AS file, "row", "col", "value" FROM grid WHERE zone <> 3 UNION ALL SELECT 'a', "row", "col" + 20, CASE WHEN zone <> 4 THEN signed END FROM grid)
SELECT "row", "col", {R('min_by("value", file)')} AS "value" FROM f WHERE "value" IS NOT NULL GROUP BY 1, 2""")
def _(t):
    g = fr.grid(t)
    left = g.filter("zone <> 3").select(F.lit("b").alias("file"), "row", "col", "value")
    right = g.select(F.lit("a").alias("file"), "row", (F.col("col") + 20).alias("col"), F.when(F.col("zone") != 4, F.col("signed")).alias("value"))
    return raster.mosaic(left.unionByName(right), ["file"]).select("row", "col", rounded("value").alias("value"))


@query("a7_raster_stats", f"""WITH {fr.GRID}
SELECT zone, {R('min(v)')} AS "min", {R('max(v)')} AS "max", {R('avg(v)')} AS mean, {R('stddev_pop(v)')} AS std,
       {R('avg(CASE WHEN v IS NOT NULL THEN CAST(v <= 0 AS INTEGER) END)')} AS zero_fraction, count(v) AS n_valid, count(*) FILTER ("col" % 11 = 0) AS n_nonfinite,
       {R('sum(v)', 4)} AS total
FROM (SELECT *, CASE WHEN "col" % 11 <> 0 THEN signed END AS v FROM grid) GROUP BY 1""")
def _(t):
    g = fr.grid(t).withColumn("v", F.when(F.col("col") % 11 == 0, float("nan")).otherwise(F.col("signed")))
    return _rounded(raster.raster_stats(g, "v", ["zone"]), total=rounded("total", 4))


@query("a8_high_latitude_threshold", f"""WITH {fr.GRID}, c AS (
  SELECT CASE WHEN "value" > 0 AND abs(90 - ("row" + 0.5) * 180 / m) >= 45 THEN "value" END AS v FROM grid, (SELECT max("row") + 1 AS m FROM grid))
SELECT count(v) AS n, {R('avg(v) + 3 * stddev_pop(v)')} AS threshold FROM c""")
def _(t):
    g = fr.grid(t)
    sized = keyed.with_scalars(g, g.agg((F.max("row") + 1).alias("m")))
    lat = 90 - (F.col("row") + 0.5) * 180 / F.col("m")
    return _rounded(raster.high_latitude_threshold(sized, lat))


@query("a9_value_counts", f"""
SELECT event_type, count(*) AS n, {R('count(*) / sum(count(*)) OVER ()')} AS share FROM events GROUP BY 1""")
def _(t):
    return _rounded(keyed.count_by(t.events, ["event_type"], "share"))


@query("a9_distinct_counts", """
SELECT event_type, count(DISTINCT user_id) AS n_storms, count(DISTINCT CAST(ts AS DATE)) AS n_days FROM events GROUP BY 1""")
def _(t):
    return t.events.groupBy("event_type").agg(F.countDistinct("user_id").alias("n_storms"), F.countDistinct(F.col("ts").cast("date")).alias("n_days"))


@query("a10_panel_coverage", f"""WITH {fr.PANEL}
SELECT CAST(y AS BIGINT) AS "year", count(*) AS n_total, count(gdp) AS n_matched, count(*) - count(gdp) AS n_missing, {R('count(gdp) / count(*)')} AS match_rate
FROM nation CROSS JOIN range(1993, 2004) AS r(y) LEFT JOIN panel p ON p.nation = n_nationkey AND p."year" = y GROUP BY 1""")
def _(t):
    full = dense_panel(t.nation.select(big("n_nationkey").alias("nation")), 1993, 2003).join(fr.panel(t), ["nation", "year"], "left")
    return _rounded(stats.coverage(full, ["year"], "gdp"), year=big("year"))


@query("a11_zone_parts", """
SELECT c_nationkey AS nation, count(*) AS parts_count, count(*) FILTER (c_acctbal < 0) AS disputed_parts_count FROM customer GROUP BY 1""")
def _(t):
    parts = t.customer.select(F.col("c_nationkey").alias("nation"), (F.col("c_acctbal") < 0).cast("int").alias("is_disputed"))
    return zone_parts(parts, "nation", "is_disputed")


@query("a12_first_last", f"""
SELECT user_id AS storm_id, CAST(min(ts) AS DATE) AS start_day, CAST(max(ts) AS DATE) AS end_day, count(*) AS n_points,
       (list(event_type ORDER BY ts, event_id))[1] AS first_basin, (list(event_type ORDER BY ts DESC, event_id DESC))[1] AS last_basin FROM events GROUP BY 1""")
def _(t):
    got = storm_summary(fr.points(t), "storm_id", "ts", "basin")
    return got.select("storm_id", F.col("start_time").cast("date").alias("start_day"), F.col("end_time").cast("date").alias("end_day"),
                      "n_points", "first_basin", "last_basin")


@query("a13_same_day_steps", """
SELECT event_id, count(*) OVER (PARTITION BY user_id, CAST(ts AS DATE)) AS same_day FROM events""")
def _(t):
    return same_day_steps(fr.points(t)).select("event_id", "same_day")


def losses(t):
    return t.orders.select(F.col("o_orderkey").alias("rec_id"),
                           F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("loss_usd"))


def paid_cells(t):
    """Line items weighted by mask, hazard and asset, whole cents times whole units."""
    return al.cell_weights(fr.weights(t), F.col("mask"), F.col("hazard"), F.col("asset"))


PAID = """cells AS (SELECT *, mask * hazard * asset AS p FROM weights),
totals AS (SELECT rec_id, CAST(sum(CAST(p AS DECIMAL(28,2))) AS DOUBLE) AS sum_weight, count(*) AS n_cells FROM cells GROUP BY 1),
losses AS (SELECT o_orderkey AS rec_id, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS loss_usd FROM orders),
alloc AS (SELECT rec_id, sum(loss_usd * p / sum_weight) AS allocated FROM cells JOIN totals USING (rec_id) JOIN losses USING (rec_id) WHERE sum_weight > 0 AND loss_usd IS NOT NULL GROUP BY 1),
summary AS (SELECT rec_id, loss_usd, coalesce(n_cells, 0) AS n_cells, coalesce(sum_weight, 0) AS sum_weight, allocated,
       CASE WHEN loss_usd IS NULL THEN 'missing_loss' WHEN n_cells IS NULL THEN 'unmatched' WHEN sum_weight <= 0 THEN 'zero_weight' ELSE 'allocated' END AS status
  FROM losses LEFT JOIN totals USING (rec_id) LEFT JOIN alloc USING (rec_id))"""


@query("a14_conservative_allocation", f"""WITH {fr.WEIGHTS}, {PAID}
SELECT rec_id, {R('loss_usd', 2)} AS loss_usd, n_cells, {R('sum_weight', 2)} AS sum_weight, status,
       {R("CASE WHEN status = 'allocated' THEN allocated ELSE 0 END", 2)} AS allocated_usd,
       {R("CASE status WHEN 'missing_loss' THEN NULL WHEN 'allocated' THEN abs(loss_usd - allocated) / greatest(loss_usd, 1) ELSE 1.0 END")} AS conservation_error
FROM summary""")
def _(t):
    got = al.allocation_summary(losses(t), paid_cells(t), "rec_id", "loss_usd", scale=2)
    return got.select("rec_id", rounded("loss_usd", 2).alias("loss_usd"), "n_cells", rounded("sum_weight", 2).alias("sum_weight"), "status",
                      rounded("allocated_usd", 2).alias("allocated_usd"), rounded("conservation_error").alias("conservation_error"))


@query("a14_same_day_split", f"""WITH {fr.WEIGHTS},
d AS (SELECT rec_id, "day", count(*) AS k FROM weights GROUP BY ALL),
c AS (SELECT w.*, mask * (hazard / k) * asset AS p FROM weights w JOIN d ON w.rec_id = d.rec_id AND w."day" = d."day"),
s AS (SELECT rec_id, sum(p) AS sp FROM c GROUP BY 1)
SELECT o_orderstatus, count(*) AS n_cells, {R('sum(o_totalprice * p / sp)', 1)} AS allocated
FROM c JOIN s USING (rec_id) JOIN orders ON o_orderkey = rec_id WHERE sp > 0 AND o_orderstatus <> 'P' GROUP BY 1""")
def _(t):
    cells = same_day_steps(fr.weights(t), "rec_id", "day")
    cells = al.cell_weights(cells, F.col("mask"), F.col("hazard"), F.col("asset"), F.col("same_day"))
    paid = al.allocate(losses(t), cells, "rec_id", "loss_usd")
    status = t.orders.select(F.col("o_orderkey").alias("rec_id"), "o_orderstatus")
    return paid.join(status, "rec_id").groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n_cells"), rounded(F.sum("allocated_usd"), 1).alias("allocated"))


@query("a15_cell_accumulation", f"""WITH {fr.WEIGHTS}, {PAID},
spread AS (SELECT wi, wj, p, p / sum_weight AS share, loss_usd * p / sum_weight AS a FROM cells JOIN totals USING (rec_id) JOIN losses USING (rec_id) WHERE sum_weight > 0 AND loss_usd IS NOT NULL),
sums AS (SELECT wi, wj, sum(a) AS loss, sum(share) AS w, count(*) FILTER (p > 0) AS n FROM spread GROUP BY ALL)
SELECT CAST(y AS BIGINT) AS wi, CAST(x AS BIGINT) AS wj, {R('coalesce(loss, 0)', 1)} AS loss_usd, {R('coalesce(w, 0)', 4)} AS weight_norm, coalesce(n, 0) AS match_count
FROM range(0, 9) AS a(y) CROSS JOIN range(0, 41) AS b(x) LEFT JOIN sums ON wi = y AND wj = x""")
def _(t):
    paid = al.allocate(losses(t), paid_cells(t), "rec_id", "loss_usd", scale=2)
    frame = t.region.filter("r_regionkey = 0").select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(8).cast("bigint"))).alias("wi")).withColumn(
        "wj", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(40).cast("bigint"))))
    got = al.accumulate_cells(paid, ["wi", "wj"], window=frame)
    return got.select("wi", "wj", rounded("loss_usd", 1).alias("loss_usd"), rounded("weight_norm", 4).alias("weight_norm"), "match_count")


@query("a16_proportional_disaggregation", f"""WITH {fr.GRID}, w AS (SELECT *, pow("value", 2) * abs(signed) AS w FROM grid),
z AS (SELECT zone, sum(w) AS zw FROM w WHERE zone > 0 GROUP BY 1)
SELECT "row", "col", {R('CASE WHEN zw > 0 AND zone % 4 <> 0 AND w > 0 THEN 1000000.0::DOUBLE * zone * w / zw ELSE 0 END', 4)} AS asset FROM w LEFT JOIN z USING (zone)""")
def _(t):
    g = fr.grid(t)
    totals = g.select("zone").distinct().withColumn("gdp", F.when(F.col("zone") % 4 != 0, F.col("zone") * F.lit(1e6)))
    weight = F.pow("value", F.lit(2.0)) * F.pow(F.abs("signed"), F.lit(1.0))
    return raster.disaggregate(g, totals, weight, "gdp").select("row", "col", rounded("asset", 4).alias("asset"))


@query("a17_year_and_all", f"""
SELECT CASE WHEN grouping(y) = 1 THEN 'ALL' ELSE CAST(y AS VARCHAR) END AS year_label, count(*) AS n, {R("count(*) FILTER (o_orderstatus = 'O') / count(*)")} AS open_rate
FROM (SELECT *, year(o_orderdate) AS y FROM orders) GROUP BY ROLLUP (y)""")
def _(t):
    df = t.orders.withColumn("year", F.year("o_orderdate"))
    return _rounded(keyed.per_year_and_all(df, "year", n_rows(), (F.count_if(F.col("o_orderstatus") == "O") / F.count(F.lit(1))).alias("open_rate")))


@query("a18_status_counts", """
SELECT CAST(year(o_orderdate) AS BIGINT) AS "year", o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2""")
def _(t):
    return keyed.count_by(t.orders.select(big(F.year("o_orderdate")).alias("year"), "o_orderstatus"), ["year", "o_orderstatus"])


P = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}
QS = ", ".join(f"{R(f'quantile_cont(l_extendedprice, {p})', 4)} AS {n}" for n, p in P.items())


@query("a19_quantiles", f"""SELECT l_returnflag, {QS} FROM lineitem GROUP BY 1""")
def _(t):
    return _rounded(exact_quantiles(t.lineitem, ["l_returnflag"], "l_extendedprice", P), 4)


@query("a19_quantiles_overall", f"""SELECT {R('quantile_cont("value", 0.5)')} AS p50, {R('quantile_cont("value", 0.999)')} AS p999 FROM events""")
def _(t):
    return _rounded(exact_quantiles(t.events, [], "value", {"p50": 0.5, "p999": 0.999}))


@query("a19_describe", f"""
SELECT o_orderstatus, count(v) AS n, {R('avg(CAST(v IS NULL AS INTEGER))')} AS missing_ratio, {R('avg(v)', 3)} AS mean, {R('stddev_pop(v)', 3)} AS std,
  {R('quantile_cont(v, 0.05)', 3)} AS p05, {R('quantile_cont(v, 0.5)', 3)} AS p50, {R('quantile_cont(v, 0.95)', 3)} AS p95
FROM (SELECT o_orderstatus, CASE WHEN o_orderkey % 8 <> 0 THEN o_totalprice END AS v FROM orders) GROUP BY 1""")
def _(t):
    df = t.orders.withColumn("v", F.when(F.col("o_orderkey") % 8 != 0, F.col("o_totalprice")))
    return _rounded(describe(df, ["o_orderstatus"], "v"), 3, missing_ratio=rounded("missing_ratio"))


@query("a20_agreement", f"""
SELECT l_returnflag, count(*) AS n, {R('avg(a - b)', 5)} AS bias, {R('avg(abs(a - b))', 5)} AS mae, {R('sqrt(avg((a - b) * (a - b)))', 5)} AS rmse, {R('max(abs(a - b))', 5)} AS max_abs, {R('corr(a, b)')} AS corr
FROM (SELECT l_returnflag, l_quantity AS a, CASE WHEN l_linenumber <> 3 THEN l_extendedprice / 1000 END AS b FROM lineitem) WHERE b IS NOT NULL GROUP BY 1""")
def _(t):
    b = F.when(F.col("l_linenumber") != 3, F.col("l_extendedprice") / 1000)
    return _rounded(t.lineitem.groupBy("l_returnflag").agg(*stats.agreement(F.col("l_quantity"), b)), 5, corr=rounded("corr"))


JS = """counts AS (SELECT b, count(*) FILTER (zone = 1) AS a, count(*) FILTER (zone = 2) AS c FROM (
    SELECT zone, CAST(least(floor("value" / 63.0::DOUBLE * 256), 255) AS BIGINT) AS b FROM grid WHERE "value" BETWEEN 0 AND 63 AND zone IN (1, 2)) GROUP BY 1),
n AS (SELECT sum(a) AS na, sum(c) AS nc FROM counts),
p AS (SELECT (coalesce(a, 0) + 1e-12::DOUBLE) / (na + 256e-12::DOUBLE) AS p, (coalesce(c, 0) + 1e-12::DOUBLE) / (nc + 256e-12::DOUBLE) AS q
      FROM range(256) AS r(i) LEFT JOIN counts ON b = i, n)"""


@query("a21_js_distance", f"""WITH {fr.GRID}, {JS}
SELECT {R('sqrt(sum(p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2)')} AS js_distance, CAST(max(na) AS BIGINT) AS n_a, CAST(max(nc) AS BIGINT) AS n_b FROM p, n""")
def _(t):
    return _rounded(raster.js_distance(fr.grid(t), "zone", 1, 2))


@query("a22_year_transitions", f"""WITH {fr.YEARLY}
SELECT CAST(a."year" AS BIGINT) AS "year", count(*) AS n, {R('avg(b."value") / avg(a."value")')} AS mean_ratio, {R('corr(a."value", b."value")')} AS corr
FROM yearly a JOIN yearly b ON a.cell = b.cell AND b."year" = a."year" + 1 GROUP BY 1""")
def _(t):
    cells = fr.yearly(t).withColumn("row", F.floor(F.col("cell") / 32)).withColumn("col", F.col("cell") % 32)
    return _rounded(stats.year_transitions(cells, F.col("year"), "value", 1), year=big("year"))


@query("a22_year_js", f"""WITH {fr.YEARLY}, v AS (SELECT "year", "value" % 63 AS x FROM yearly WHERE "value" % 63 BETWEEN 0 AND 63),
h AS (SELECT "year", CAST(least(floor(x / 63.0::DOUBLE * 16), 15) AS BIGINT) AS b, count(*) AS n FROM v GROUP BY ALL), t AS (SELECT "year", sum(n) AS n FROM h GROUP BY 1),
p AS (SELECT a."year", (coalesce(x.n, 0) + 1e-12::DOUBLE) / (a.n + 16e-12::DOUBLE) AS p, (coalesce(y.n, 0) + 1e-12::DOUBLE) / (c.n + 16e-12::DOUBLE) AS q
  FROM t a JOIN t c ON c."year" = a."year" + 1 CROSS JOIN range(16) AS r(i) LEFT JOIN h x ON x."year" = a."year" AND x.b = i LEFT JOIN h y ON y."year" = c."year" AND y.b = i)
SELECT CAST("year" AS BIGINT) AS "year", {R('sqrt(greatest(sum(p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2, 0))', 5)} AS js_distance FROM p GROUP BY 1""")
def _(t):
    cells = fr.yearly(t).withColumn("value", F.col("value") % 63)
    return raster.year_js_distances(cells, "year", bins=16).select(big("year").alias("year"), rounded("js_distance", 5).alias("js_distance"))


@query("a8_threshold_by_zone", f"""WITH {fr.GRID}, c AS (
  SELECT zone, CASE WHEN "value" > 0 AND abs(90 - ("row" + 0.5) * 180 / m) >= 45 THEN "value" END AS v FROM grid, (SELECT max("row") + 1 AS m FROM grid))
SELECT zone, count(v) AS n, {R("CASE WHEN count(v) >= 100 THEN avg(v) + 3 * stddev_pop(v) END")} AS threshold FROM c GROUP BY 1""")
def _(t):
    g = fr.grid(t)
    sized = keyed.with_scalars(g, g.agg((F.max("row") + 1).alias("m")))
    got = raster.high_latitude_threshold(sized, 90 - (F.col("row") + 0.5) * 180 / F.col("m"), min_count=100, by=["zone"])
    return got.select("zone", "n", rounded(F.when(F.col("threshold") < float("inf"), F.col("threshold"))).alias("threshold"))


@query("a23_knot_fidelity", f"""WITH {fr.YEARLY},
k AS (SELECT * FROM yearly WHERE "year" IN (1996, 1997, 1998, 1999, 2000))
SELECT CAST("year" AS BIGINT) AS "year", count(*) AS n, 0.0::DOUBLE AS mae, 0.0::DOUBLE AS max_abs FROM k GROUP BY 1""")
def _(t):
    knots = [1996, 1997, 1998, 1999, 2000]
    series = fr.yearly(t)
    rebuilt = log_pchip(series.filter(F.col("year").isin(knots)), ["cell"], "year", "value", knots, 1995, 2001)
    got = knot_fidelity(series.filter(F.col("year").isin(knots)), rebuilt, ["cell"], "year", "value")
    return _rounded(got, year=big("year"))


@query("a24_conservation", f"""WITH {fr.GRID}, s AS (SELECT zone, sum("value") AS a FROM grid GROUP BY 1)
SELECT zone, {R('a', 4)} AS actual, {R('t', 4)} AS target, {R('abs(a - t)', 4)} AS abs_error, {R('abs(a - t) / t')} AS rel_error, CAST(abs(a - t) / t <= 1e-6 AS BIGINT) AS valid
FROM (SELECT zone, a, a * CASE WHEN zone % 3 = 0 THEN 1.01::DOUBLE ELSE 1.0::DOUBLE END AS t FROM s)""")
def _(t):
    sums = fr.grid(t).groupBy("zone").agg(F.sum("value").alias("actual"))
    target = sums.select("zone", (F.col("actual") * F.when(F.col("zone") % 3 == 0, 1.01).otherwise(1.0)).alias("target"))
    return _rounded(stats.conservation(target, sums, "target", "actual", ["zone"]), 4, rel_error=rounded("rel_error"), valid=big("valid"))


@query("a25_fill_ratio", f"""WITH {fr.MONTHLY}, m AS (SELECT "year", CASE WHEN "month" <> 2 THEN avg_rad END AS avg_rad, CASE WHEN cf_cvg > 20 THEN cf_cvg END AS cf_cvg FROM monthly)
SELECT CAST("year" AS BIGINT) AS "year", variable, {R('fill_ratio')} AS fill_ratio FROM (
  SELECT "year", avg(CAST(avg_rad IS NULL AS INTEGER)) AS avg_rad, avg(CAST(cf_cvg IS NULL AS INTEGER)) AS cf_cvg FROM m GROUP BY 1) UNPIVOT (fill_ratio FOR variable IN (avg_rad, cf_cvg))""")
def _(t):
    m = fr.monthly(t).withColumn("avg_rad", F.when(F.col("month") != 2, F.col("avg_rad"))).withColumn(
        "cf_cvg", F.when(F.col("cf_cvg") > 20, F.col("cf_cvg")))
    return _rounded(stats.fill_ratio(m, ["year"], ["avg_rad", "cf_cvg"]), year=big("year"))


WINDOW_EVENTS = """we AS (SELECT user_id AS event, CAST(ts AS DATE) AS "day", event_id AS step, (event_id // 7) % 6 AS wi, event_id % 5 AS wj, "value" AS ours, "value" * (1 + (event_id % 9)) / 5.0::DOUBLE AS theirs FROM events),
dm AS (SELECT event, "day", wi, wj, avg(ours) AS ours, avg(theirs) AS theirs FROM we GROUP BY ALL)"""


def window_events(t):
    e = F.col("event_id")
    return t.events.select(F.col("user_id").alias("event"), F.col("ts").cast("date").alias("day"), e.alias("step"),
                           (F.floor(e / 7) % 6).alias("wi"), (e % 5).alias("wj"), F.col("value").alias("ours"),
                           (F.col("value") * (1 + e % 9) / 5.0).alias("theirs"))


@query("a26_event_footprint", f"""WITH {WINDOW_EVENTS}
SELECT event, CAST(wi AS BIGINT) AS wi, CAST(wj AS BIGINT) AS wj, {R('sum(ours)', 4)} AS ours, {R('sum(theirs)', 4)} AS theirs FROM dm GROUP BY ALL""")
def _(t):
    means = external.event_day_means(window_events(t), "event", "day", ["ours", "theirs"])
    return _rounded(external.event_totals(means, "event", ["ours", "theirs"], "day")[0], 4)


@query("a26_event_daily_totals", f"""WITH {WINDOW_EVENTS}
SELECT event, "day", {R('sum(ours)', 4)} AS ours, {R('sum(theirs)', 4)} AS theirs FROM dm GROUP BY ALL""")
def _(t):
    means = external.event_day_means(window_events(t), "event", "day", ["ours", "theirs"])
    return _rounded(external.event_totals(means, "event", ["ours", "theirs"], "day")[1], 4)


@query("a27_event_mean_grid", f"""WITH {WINDOW_EVENTS}
SELECT event, CAST(wi AS BIGINT) AS wi, CAST(wj AS BIGINT) AS wj, {R('avg(ours)')} AS ours FROM we GROUP BY ALL""")
def _(t):
    return _rounded(window_events(t).groupBy("event", "wi", "wj").agg(F.avg("ours").alias("ours")))


@query("a28_snap_to_grid", f"""WITH {fr.POINTS},
k AS (SELECT storm_id, obs_date, count(DISTINCT event_id) AS k FROM points GROUP BY ALL),
c AS (SELECT storm_id, obs_date, CAST(round_even((center_lat - 5.0::DOUBLE) / 0.7::DOUBLE, 0) AS BIGINT) AS grid_i, CAST(round_even((center_lon - 100.0::DOUBLE) / 0.7::DOUBLE, 0) AS BIGINT) AS grid_j, sum(wind_kt) AS v FROM points GROUP BY ALL)
SELECT storm_id, grid_i, grid_j, {R('sum(v / k)', 5)} AS wind_kt FROM c JOIN k USING (storm_id, obs_date) GROUP BY ALL""")
def _(t):
    return _rounded(external.snap_to_grid(fr.points(t), "storm_id", "obs_date", "event_id", "center_lat", "center_lon", "wind_kt", 5.0, 0.7, 100.0, 0.7), 5)


@query("a29_box_day_sum", f"""WITH {fr.DAILY}
SELECT lat_idx, lon_idx, {R('sum("value")', 4)} AS total FROM daily WHERE lat_idx BETWEEN 20 AND 60 AND lon_idx BETWEEN 10 AND 70 AND "day" BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY ALL""")
def _(t):
    box = fr.daily(t).filter("lat_idx between 20 and 60 and lon_idx between 10 and 70 and day between date'2024-01-05' and date'2024-01-20'")
    return _rounded(box.groupBy("lat_idx", "lon_idx").agg(F.sum("value").alias("total")), 4)


AUDIT = """audit AS (SELECT s.*, year(o_orderdate) AS "year", CASE status WHEN 'missing_loss' THEN NULL WHEN 'allocated' THEN 0.0 ELSE 1.0 END AS err,
  rec_id % 2 = 0 AS avoidable FROM summary s JOIN orders ON o_orderkey = rec_id)"""


def audit(t):
    summary = al.allocation_summary(losses(t), paid_cells(t), "rec_id", "loss_usd", scale=2)
    years = t.orders.select(F.col("o_orderkey").alias("rec_id"), F.year("o_orderdate").alias("year"))
    return summary.join(years, "rec_id").withColumn("avoidable", F.col("rec_id") % 2 == 0)


@query("a30_attribution_ratios", f"""WITH {fr.WEIGHTS}, {PAID}, {AUDIT}
SELECT CAST(count(*) FILTER (loss_usd > 0) AS BIGINT) AS with_loss, {R("count(*) FILTER (loss_usd > 0 AND status = 'unmatched') / count(*) FILTER (loss_usd > 0)")} AS unmatched_ratio,
  {R("count(*) FILTER (loss_usd > 0 AND status = 'zero_weight' AND avoidable) / count(*) FILTER (loss_usd > 0)")} AS avoidable_ratio,
  {R("count(*) FILTER (loss_usd > 0 AND status = 'zero_weight' AND NOT avoidable) / count(*) FILTER (loss_usd > 0)")} AS unavoidable_ratio FROM audit""")
def _(t):
    verdict = attribution_verdict(attribution_by_year(audit(t)))
    return _rounded(verdict.select("with_loss", "unmatched_ratio", "avoidable_ratio", "unavoidable_ratio"))


@query("a31_daily_coverage", f"""
WITH d AS (SELECT DISTINCT year(o_orderdate) AS y, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderpriority LIKE '1%'),
s AS (SELECT DISTINCT year(o_orderdate) + k AS y FROM orders, (VALUES (0), (10)) AS v(k))
SELECT CAST(s.y AS BIGINT) AS "year", count(d) AS n_days, CAST(dayofyear(make_date(s.y, 12, 31)) AS BIGINT) AS expected, {R('count(d) / dayofyear(make_date(s.y, 12, 31))')} AS coverage,
  CASE WHEN count(d) > 0 THEN 1.0::DOUBLE END AS readable
FROM s LEFT JOIN d ON s.y = d.y GROUP BY s.y""")
def _(t):
    days = t.orders.filter(F.col("o_orderpriority").startswith("1")).select(F.col("o_orderdate").cast("date").alias("day"))
    year = F.year("o_orderdate")
    years = t.orders.select(F.explode(F.array(year, year + 10)).alias("year"))
    return _rounded(external.daily_coverage(days, "day", years), year=big("year"), expected=big("expected"), readable=F.col("readable"))


@query("a32_yearly_medians", f"""WITH {fr.MONTHLY}
SELECT CAST("year" AS BIGINT) AS "year", {R('quantile_cont(avg_rad, 0.5)', 3)} AS median, {R('avg(avg_rad)', 3)} AS mean FROM monthly GROUP BY 1""")
def _(t):
    m = fr.monthly(t)
    medians = exact_quantiles(m, ["year"], "avg_rad", {"median": 0.5})
    return _rounded(medians.join(m.groupBy("year").agg(F.avg("avg_rad").alias("mean")), "year"), 3, year=big("year"))


@query("a33_weighted_rate", f"""
SELECT CAST(sum(n) AS BIGINT) AS n, {R('sum(n * r) / sum(n)')} AS rate FROM (
  SELECT year(o_orderdate) AS y, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') / count(*) AS r FROM orders GROUP BY 1)""")
def _(t):
    yearly = t.orders.groupBy(F.year("o_orderdate").alias("year")).agg(n_rows(), F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("r"))
    return _rounded(stats.weighted_rate(yearly, "n", "r"))


@query("a34_display_limits", f"""WITH {fr.GRID}
SELECT zone, {R('quantile_cont(signed, 0.02)')} AS low, {R('quantile_cont(signed, 0.98)')} AS high FROM grid WHERE signed > 0 GROUP BY 1""")
def _(t):
    q = exact_quantiles(fr.grid(t).filter("signed > 0"), ["zone"], "signed", {"lo": 0.02, "hi": 0.98})
    limits = q.select("zone", stats.display_limits(F.array("lo", "hi")).alias("l"))
    return limits.select("zone", rounded(F.col("l")[0]).alias("low"), rounded(F.col("l")[1]).alias("high"))


@query("a35_nonzero_share", f"""WITH {fr.GRID}
SELECT zone, count(*) FILTER (signed > 0) AS n_nonzero, {R('avg(CAST(signed > 0 AS INTEGER))')} AS share FROM grid GROUP BY 1""")
def _(t):
    hit = F.col("signed") > 0
    return _rounded(fr.grid(t).groupBy("zone").agg(F.count_if(hit).alias("n_nonzero"), F.avg(hit.cast("double")).alias("share")))


@query("a36_flood_overlap", f"""WITH {fr.ANCHORS}, {fr.GRID},
s AS (SELECT p.storm_id, p.wind_kt AS hazard, g."value" - 5 AS flooded, g.signed AS duration, CAST(g."value" < 20 AS INTEGER) AS permwater
      FROM anchors a JOIN points p ON p.event_id = a.event_id LEFT JOIN grid g ON a."row" = g."row" AND a."col" = g."col")
SELECT storm_id, count(*) AS n_points, count(flooded) AS n_valid, {R('f')} AS flooded_ratio, {R('n')} AS flooded_ratio_new, {R('CASE WHEN f > 0 THEN (f - n) / f ELSE 0 END')} AS permanent_exclusion,
       CASE WHEN count(flooded) >= 3 THEN {R('corr(duration, hazard)')} END AS duration_corr
FROM (SELECT *, avg(CAST(flooded > 0 AS INTEGER)) OVER w AS f, avg(CAST(flooded > 0 AND permwater = 0 AS INTEGER)) OVER w AS n FROM s WINDOW w AS (PARTITION BY storm_id))
GROUP BY storm_id, f, n""")
def _(t):
    g = fr.grid(t).select("row", "col", (F.col("value") - 5).alias("flooded"), F.col("signed").alias("duration"), (F.col("value") < 20).cast("int").alias("permwater"))
    winds = fr.points(t).select("event_id", "storm_id", F.col("wind_kt").alias("hazard"))
    samples = fr.anchors(t).join(winds, "event_id").join(g, ["row", "col"], "left")
    return _rounded(external.flood_overlap(samples, ["storm_id"]))


@query("a37_line_fit", f"""
SELECT l_returnflag, {R('regr_slope(l_extendedprice, l_quantity)', 4)} AS slope, {R('regr_intercept(l_extendedprice, l_quantity)', 3)} AS intercept, count(*) AS n FROM lineitem GROUP BY 1""")
def _(t):
    return _rounded(t.lineitem.groupBy("l_returnflag").agg(*stats.line_fit(F.col("l_quantity"), F.col("l_extendedprice"))), 4, intercept=rounded("intercept", 3))


@query("a38_joined_set", """
SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, ';' ORDER BY c_mktsegment) AS segments FROM customer GROUP BY 1""")
def _(t):
    return t.customer.groupBy("c_nationkey").agg(joined_set(F.col("c_mktsegment")).alias("segments"))


@query("a39_zone_scan", f"""WITH {fr.GRID}
SELECT count(DISTINCT zone) AS n_zones, min(zone) AS min_zone, max(zone) AS max_zone FROM grid WHERE zone > 0""")
def _(t):
    return fr.grid(t).filter("zone > 0").agg(F.countDistinct("zone").alias("n_zones"), F.min("zone").alias("min_zone"), F.max("zone").alias("max_zone"))


@query("a40_dissolved_containment", f"""WITH {fr.POINTS}, {fr.OUTLINES}, inside AS (SELECT event_id, unit_id FROM points JOIN outlines
  ON (y1 > center_lat) <> (y2 > center_lat) AND center_lon < (x2 - x1) * (center_lat - y1) / nullif(y2 - y1, 0) + x1 GROUP BY 1, 2 HAVING count(*) % 2 = 1)
SELECT n_regionkey, count(DISTINCT event_id) AS n_points FROM inside JOIN nation ON n_nationkey = unit_id GROUP BY 1""")
def _(t):
    keys = t.nation.select(big("n_nationkey").alias("unit_id"), "n_regionkey")
    edges = spatial.dissolve(fr.outlines(t), keys, "n_regionkey")
    p = fr.points(t)
    parts = spatial.points_in_units(p, edges, "center_lon", "center_lat")
    hits = p.join(parts, ["center_lon", "center_lat"]).join(keys, "unit_id").select("event_id", "n_regionkey").distinct()
    return hits.groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("n_points"))
