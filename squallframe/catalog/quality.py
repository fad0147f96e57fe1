"""Validation levels and whole workflows (Q rows of the inventory)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hazard as hz
from ..functions import status as st
from ..operators import external, quality, raster, stats, windows
from ..operators.allocation import diagnose_zero_weight
from ..operators.keyed import with_scalars
from ..operators.quantiles import exact_quantiles, exact_quantiles_of
from ..sources.sinks import save_table
from . import frames as fr
from .aggregates import AUDIT, PAID, WINDOW_EVENTS, _rounded, audit, losses, window_events
from .joins import FLOODS, LINKED, SHIP_EVENTS, floods, ship_events
from .base import QUERIES, R, SQL, big, n_rows, query, rounded, scratch_table


@query("q1_input_inventory", """
WITH want AS (SELECT n_nationkey AS n, y, m FROM nation, range(1995, 2002) AS a(y), range(1, 13) AS b(m)),
have AS (SELECT DISTINCT s_nationkey AS n, year(l_shipdate) AS y, month(l_shipdate) AS m FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity > 40)
SELECT 'error' AS level, 'shipments' AS scope, concat_ws('/', n, y, m) AS item, 'missing' AS issue FROM (FROM want EXCEPT FROM have)
UNION ALL SELECT 'warning', 'shipments', concat_ws('/', n, y, m), 'unexpected' FROM (FROM have EXCEPT FROM want)""")
def _(t):
    want = (t.nation.select(F.col("n_nationkey").alias("n"), F.explode(F.sequence(F.lit(1995), F.lit(2001))).alias("y"))
            .withColumn("m", F.explode(F.sequence(F.lit(1), F.lit(12)))))
    have = t.lineitem.filter("l_quantity > 40").join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.col("s_nationkey").alias("n"), F.year("l_shipdate").alias("y"), F.month("l_shipdate").alias("m"))
    return quality.inventory(want, have, ["n", "y", "m"], "shipments")


@query("q2_spec_consistency", """
WITH s AS (SELECT p_brand, p_partkey, p_size % 2 AS dtype, p_retailprice AS res FROM part), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) = 1)
SELECT s.p_brand, s.p_partkey, 'dtype' AS field FROM s JOIN b USING (p_brand) WHERE s.dtype <> b.dtype
UNION ALL SELECT s.p_brand, s.p_partkey, 'res' FROM s JOIN b USING (p_brand) WHERE abs(s.res - b.res) > 25.005""")
def _(t):
    specs = t.part.select("p_brand", "p_partkey", (F.col("p_size") % 2).alias("dtype"), F.col("p_retailprice").alias("res"))
    return quality.spec_mismatches(specs, "p_brand", "p_partkey", ["dtype"], {"res": 25.005})


@query("q2_expected_grid", """
SELECT p_partkey, unnest(list_filter([CASE WHEN p_type <> t THEN 'crs' END, CASE WHEN p_size <> 7 THEN 'width' END, CASE WHEN abs(p_retailprice - 1000) > 250.005 THEN 'lon_min' END], lambda x: x IS NOT NULL)) AS field
FROM part, (SELECT 'STANDARD' AS t)""")
def _(t):
    specs = t.part.select("p_partkey", F.col("p_type").alias("crs"), F.col("p_size").alias("width"), F.col("p_retailprice").alias("lon_min"))
    return quality.spec_differences(specs, ["p_partkey"], {"crs": "STANDARD", "width": 7}, {"lon_min": (1000.0, 250.005)})


@query("q3_required_variables", """
WITH g AS (SELECT DISTINCT user_id FROM events), v AS (SELECT * FROM (VALUES ('click'), ('view'), ('purchase'), ('refund')) AS r(event_type))
SELECT user_id, event_type FROM g, v EXCEPT SELECT user_id, event_type FROM events WHERE "value" > 100""")
def _(t):
    return quality.required_gaps(t.events.filter("value > 100"), ["click", "view", "purchase", "refund"], "user_id", "event_type", t.events)


@query("q4_stage_drift", """
WITH a AS (SELECT user_id, event_type, max(event_id) % 3 AS kind FROM events WHERE "value" > 60 GROUP BY 1, 2),
b AS (SELECT user_id, event_type, max(event_id) % 3 AS kind FROM events WHERE "value" < 90 GROUP BY 1, 2)
SELECT user_id, event_type, a.kind AS kind_before, b.kind AS kind_after,
       CASE WHEN b.kind IS NULL THEN 'missing_in_after' WHEN a.kind IS NULL THEN 'extra_in_after' ELSE 'changed' END AS issue
FROM a FULL JOIN b USING (user_id, event_type) WHERE a.kind IS DISTINCT FROM b.kind""")
def _(t):
    def stage(condition):
        return t.events.filter(condition).groupBy("user_id", "event_type").agg((F.max("event_id") % 3).alias("kind"))
    return quality.stage_drift(stage("value > 60"), stage("value < 90"), ["user_id", "event_type"], ["kind"])


PRICE_STATUS = "CASE WHEN {0} > 104000 THEN 3 WHEN {0} > 103000 THEN 2 ELSE 1 END"


@query("q5_status_matrix", f"""
WITH s AS (SELECT CAST(year(l_shipdate) * 100 + month(l_shipdate) AS BIGINT) AS "year", l_returnflag AS f, max({PRICE_STATUS.format('l_extendedprice')}) AS r FROM lineitem GROUP BY 1, 2)
SELECT "year", ['PASS', 'WARN', 'FAIL'][max(CASE WHEN f = 'A' THEN r END)] AS "A", ['PASS', 'WARN', 'FAIL'][max(CASE WHEN f = 'N' THEN r END)] AS "N",
       ['PASS', 'WARN', 'FAIL'][max(CASE WHEN f = 'R' THEN r END)] AS "R" FROM s GROUP BY 1""")
def _(t):
    marked = t.lineitem.select(big(F.year("l_shipdate") * 100 + F.month("l_shipdate")).alias("year"), "l_returnflag",
                               st.above(F.col("l_extendedprice"), 104000.0, 103000.0).alias("status"))
    return quality.status_matrix(marked, "year", "l_returnflag", ["A", "N", "R"], "status")


@query("q6_track_physics", f"""WITH {fr.POINTS},
y AS (SELECT basin, obs_date, avg(wind_kt) AS m FROM points GROUP BY 1, 2),
z AS (SELECT *, (m - avg(m) OVER w) / stddev_pop(m) OVER w AS z FROM y WINDOW w AS (PARTITION BY basin))
SELECT basin, obs_date, {R('m')} AS mean, {R('z')} AS z_score, CASE WHEN abs(z) > 2 THEN 'WARN' ELSE 'PASS' END AS status FROM z""")
def _(t):
    daily = fr.points(t).groupBy("basin", "obs_date").agg(F.avg("wind_kt").alias("mean"))
    got = quality.drift_status(daily, "basin", "mean", 2.0)
    return got.select("basin", "obs_date", rounded("mean").alias("mean"), rounded("z_score").alias("z_score"), "status")


@query("q6_stage_agreement", f"""WITH {fr.POINTS}, q AS (SELECT basin, wind_kt AS a, wind_kt + (event_id % 7) / 100.0::DOUBLE AS b FROM points WHERE wind_kt > 3)
SELECT basin, count(*) AS n, {R('avg(b - a)')} AS bias, {R('avg(abs(b - a))')} AS mae, {R('sqrt(avg((b - a) * (b - a)))')} AS rmse, {R('max(abs(b - a))')} AS max_abs, {R('corr(b, a)')} AS corr FROM q GROUP BY 1""")
def _(t):
    base = fr.points(t).select("basin", "event_id", F.col("wind_kt").alias("v"))
    final = base.filter("v > 3").withColumn("v", F.col("v") + (F.col("event_id") % 7) / 100.0)
    return _rounded(quality.compare_stages(base, final, ["basin", "event_id"], "v", ["basin"]))


SAMPLE = """sample AS (SELECT event_id, "row", "col" FROM anchors),
src AS (SELECT s.event_id, dr // 4 AS bi, dc // 4 AS wj, sum(g."value") AS v FROM sample s, range(12) AS x(dr), range(12) AS y(dc), grid g
        WHERE g."row" = s."row" - 6 + dr AND g."col" = s."col" - 6 + dc GROUP BY ALL),
stored AS (SELECT event_id, 2 - bi AS wi, wj, CASE WHEN event_id % 3 = 0 THEN v + 0.001::DOUBLE ELSE v END AS v FROM src),
j AS (SELECT s.event_id, f.v - s.v AS fg, n.v - s.v AS ng FROM stored s LEFT JOIN src f ON f.event_id = s.event_id AND 2 - f.bi = s.wi AND f.wj = s.wj LEFT JOIN src n ON n.event_id = s.event_id AND n.bi = s.wi AND n.wj = s.wj)"""


@query("q7_window_alignment", f"""WITH {fr.ANCHORS}, {fr.GRID}, {SAMPLE}
SELECT event_id, {R('avg(abs(fg))')} AS mae, {R('sqrt(avg(fg * fg))')} AS rmse, {R('max(abs(fg))')} AS max_abs, count(fg) AS valid_cells, {R('avg(abs(ng))', 4)} AS mae_unflipped,
       CAST(coalesce(avg(abs(fg)) <= avg(abs(ng)), FALSE) AS BIGINT) AS orientation_pass, CASE WHEN avg(abs(fg)) > 1e-5 THEN 'FAIL' ELSE 'PASS' END AS status FROM j GROUP BY 1""")
def _(t):
    sample = fr.anchors(t)
    g = fr.grid(t).select("row", "col", "value")
    flipped = windows.extract_windows(sample, g, size=3, factor=4)
    straight = flipped.withColumn("wi", 2 - F.col("wi"))  # the same blocks, read the other way up
    stored = flipped.filter("value is not null").withColumn(
        "value", F.when(F.col("event_id") % 3 == 0, F.col("value") + 0.001).otherwise(F.col("value")))
    got = quality.alignment_check(stored, straight, flipped, ["event_id"], "value")
    return _rounded(got, mae_unflipped=rounded("mae_unflipped", 4), orientation_pass=big("orientation_pass"))


@query("q7_missing_rasters", f"""WITH {fr.ANCHORS}, {fr.GRID}, {SAMPLE},
a AS (SELECT event_id, avg(abs(fg)) AS mae, count(fg) AS valid_cells, CAST(coalesce(avg(abs(fg)) <= avg(abs(ng)), FALSE) AS BIGINT) AS orientation_pass, CASE WHEN avg(abs(fg)) > 1e-5 THEN 'FAIL' ELSE 'PASS' END AS status FROM j GROUP BY 1)
SELECT s.event_id, 'light' AS variable, {R('mae')} AS mae, coalesce(valid_cells, 0) AS valid_cells, coalesce(orientation_pass, 0) AS orientation_pass, coalesce(status, 'FAIL') AS status,
  CASE WHEN a.event_id IS NULL THEN 'missing_raster:/layers/light.tif' ELSE '' END AS note FROM sample s LEFT JOIN a USING (event_id)
UNION ALL SELECT event_id, 'people', NULL, 0, 0, 'FAIL', 'missing_raster:/layers/people.tif' FROM sample""")
def _(t):
    """Two layers are planned and one has a raster."""
    sample = fr.anchors(t)
    g = fr.grid(t).select("row", "col", "value")
    flipped = windows.extract_windows(sample, g, size=3, factor=4)
    straight = flipped.withColumn("wi", 2 - F.col("wi"))
    stored = flipped.filter("value is not null").withColumn(
        "value", F.when(F.col("event_id") % 3 == 0, F.col("value") + 0.001).otherwise(F.col("value")))
    checked = quality.alignment_check(stored, straight, flipped, ["event_id"], "value").withColumn("variable", F.lit("light"))
    planned = sample.select("event_id", F.explode(F.array(F.lit("light"), F.lit("people"))).alias("variable")).withColumn(
        "path", F.concat(F.lit("/layers/"), "variable", F.lit(".tif")))
    got = quality.with_missing_rasters(checked, planned, ["event_id"])
    return got.select("event_id", "variable", rounded("mae").alias("mae"), big("valid_cells").alias("valid_cells"), big("orientation_pass").alias("orientation_pass"), "status", "note")


@query("q8_hazard_formulas", f"""WITH {fr.GRID},
a AS (SELECT *, sqrt("value" * "value" + signed * signed) AS w, CASE WHEN zone = 5 THEN signed ELSE abs(signed) END AS rain FROM grid),
b AS (SELECT *, w + CASE WHEN zone = 1 THEN 0.5::DOUBLE ELSE 0 END AS wind FROM a),
c AS (SELECT *, pow(greatest(wind - {hz.WIND_THRESHOLD}, 0), 3) AS p, pow(greatest(wind - {hz.WIND_THRESHOLD}, 0), 3) * CASE WHEN zone = 2 THEN 2.0::DOUBLE ELSE 1 END AS hw FROM b),
d AS (SELECT *, min(hw) OVER x AS w0, max(hw) OVER x AS w1, min(rain) OVER x AS r0, max(rain) OVER x AS r1 FROM c WINDOW x AS (PARTITION BY "row")),
e AS (SELECT *, CASE WHEN w1 > w0 THEN (hw - w0) / (w1 - w0) ELSE 0 END * 0.5::DOUBLE + CASE WHEN r1 > r0 THEN (rain - r0) / (r1 - r0) ELSE 0 END * 0.5::DOUBLE AS h FROM d)
SELECT zone, n_cells, {R("we")} AS wind_max_error, {R("pe")} AS hazard_wind_rel_error, {R("he")} AS hazard_compound_max_error, n_negative,
       CASE WHEN greatest(we, ae, he) > {quality.FORMULA_ERROR_FAIL} OR n_negative > 0 OR n_out > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM (
  SELECT zone, count(*) AS n_cells, max(abs(wind - w)) AS we, max(abs(hw - p) / (1 + p)) AS pe, max(abs(hw - p)) AS ae, max(abs(stored - h)) AS he, count(*) FILTER (rain < 0) AS n_negative,
    count(*) FILTER (stored < 0 OR stored > 1) AS n_out
  FROM (SELECT *, CASE WHEN zone = 3 THEN h + 0.25::DOUBLE ELSE h END AS stored FROM e) GROUP BY 1)""")
def _(t):
    zone = F.col("zone")
    g = fr.grid(t).withColumn("u10", F.col("value")).withColumn("v10", F.col("signed"))
    g = g.withColumn("wind", hz.wind_speed(F.col("u10"), F.col("v10")) + F.when(zone == 1, 0.5).otherwise(0.0))
    g = g.withColumn("hazard_wind", hz.wind_power(F.col("wind")) * F.when(zone == 2, 2.0).otherwise(1.0))
    g = g.withColumn("hazard_rain", F.when(zone == 5, F.col("signed")).otherwise(F.abs("signed")))
    g = windows.compound_hazard(g, "hazard_wind", "hazard_rain", ["row"]).withColumn(
        "hazard_compound", F.when(zone == 3, F.col("hazard_compound") + 0.25).otherwise(F.col("hazard_compound")))
    got = quality.formula_check(g, ["row"], ["zone"])
    power = hz.wind_power(F.col("wind"))
    relative = g.groupBy("zone").agg(F.max(F.abs(F.col("hazard_wind") - power) / (1 + power)).alias("hazard_wind_rel_error"))
    return got.join(relative, "zone").select("zone", "n_cells", *[rounded(c).alias(c) for c in ("wind_max_error", "hazard_wind_rel_error", "hazard_compound_max_error")], "n_negative", "status")


@query("q9_hazard_distribution", f"""WITH {fr.GRID},
s AS (SELECT zone, "value" FROM grid)
SELECT zone, {R('quantile_cont("value", 0.1)')} AS p10, {R('quantile_cont("value", 0.5)')} AS p50, {R('quantile_cont("value", 0.99)')} AS p99 FROM s GROUP BY 1""")
def _(t):
    return _rounded(exact_quantiles(fr.grid(t), ["zone"], "value", {"p10": 0.1, "p50": 0.5, "p99": 0.99}))


FAILS = """CASE WHEN count(*) FILTER (loss_usd > 0 AND status = 'unmatched') >= 2 THEN 'FAIL'
            WHEN count(*) FILTER (loss_usd > 0 AND status = 'zero_weight' AND NOT avoidable) > 0 THEN 'WARN' ELSE 'PASS' END"""


@query("q10_attribution_by_year", f"""WITH {fr.WEIGHTS}, {PAID}, {AUDIT}
SELECT CAST("year" AS BIGINT) AS "year", count(*) FILTER (status = 'allocated') AS allocated_count, {R("max(CASE WHEN status = 'allocated' THEN 0.0 END)")} AS max_error,
  count(*) FILTER (loss_usd > 0) AS with_loss, count(*) FILTER (loss_usd > 0 AND status = 'unmatched') AS unmatched_with_loss,
  count(*) FILTER (loss_usd > 0 AND status = 'zero_weight' AND avoidable) AS zero_avoidable, count(*) FILTER (loss_usd > 0 AND status = 'zero_weight' AND NOT avoidable) AS zero_unavoidable,
  CASE WHEN count(*) FILTER (loss_usd > 0 AND status = 'unmatched') >= 2 THEN 'unmatched_with_loss_count_year' ELSE '' END AS fail_reasons, {FAILS} AS status FROM audit GROUP BY 1""")
def _(t):
    return _rounded(quality.attribution_by_year(audit(t)).drop("mean_error"), year=big("year"))


@query("q10_attribution_verdict", f"""WITH {fr.WEIGHTS}, {PAID}, {AUDIT},
y AS (SELECT "year", {FAILS} AS status FROM audit GROUP BY 1),
r AS (SELECT count(*) FILTER (loss_usd > 0) AS k, count(*) FILTER (loss_usd > 0 AND status = 'unmatched') AS u, count(*) FILTER (loss_usd > 0 AND status = 'zero_weight' AND avoidable) AS a FROM audit)
SELECT k AS with_loss, (SELECT count(*) FROM y WHERE status = 'FAIL') AS failed_years,
  concat_ws(';', CASE WHEN (SELECT count(*) FROM y WHERE status = 'FAIL') > 0 THEN 'year_level_hard_fail' END, CASE WHEN u / k > 0.02 THEN 'unmatched_with_loss_ratio_global' END,
            CASE WHEN a / k > 0.02 THEN 'zero_weight_avoidable_ratio_global' END) AS fail_reasons FROM r""")
def _(t):
    return quality.attribution_verdict(quality.attribution_by_year(audit(t))).select("with_loss", "failed_years", "fail_reasons")


@query("q10_distributions", f"""WITH s AS (SELECT 'all_records' AS scope, o_orderpriority AS category FROM orders UNION ALL SELECT 'with_loss', o_orderpriority FROM orders WHERE o_orderstatus <> 'P')
SELECT scope, category, count(*) AS n, {R('count(*) / sum(count(*)) OVER (PARTITION BY scope)')} AS share FROM s GROUP BY 1, 2""")
def _(t):
    return _rounded(quality.distributions(t.orders, "o_orderpriority", F.col("o_orderstatus") != "P"))


@query("q11_zero_weight_diagnosis", f"""WITH {fr.WEIGHTS}, c AS (SELECT rec_id, CASE WHEN wi = 3 THEN 0 ELSE mask END AS mask, CASE WHEN wi <> 7 THEN CASE WHEN hazard > 15 THEN hazard ELSE 0 END END AS hazard, asset FROM weights),
f AS (SELECT rec_id, count(*) AS n, count(*) FILTER (mask > 0) AS m, count(*) FILTER (mask > 0 AND hazard IS NOT NULL) AS k, max(CASE WHEN mask > 0 THEN hazard END) AS h FROM c GROUP BY 1)
SELECT d AS diagnosis, d <> 'mask_all_zero' AS avoidable, count(*) AS n FROM (
  SELECT CASE WHEN n IS NULL THEN 'no_overlap_time_indices' WHEN m = 0 THEN 'mask_all_zero' WHEN k = 0 THEN 'all_nonfinite_or_missing' WHEN h <= 0 THEN 'hazard_all_zero_under_mask' ELSE 'all_nonfinite_or_missing' END AS d
  FROM orders LEFT JOIN f ON rec_id = o_orderkey WHERE o_orderstatus <> 'P') GROUP BY 1, 2""")
def _(t):
    cells = fr.weights(t).withColumn("mask", F.when(F.col("wi") == 3, 0).otherwise(F.col("mask"))).withColumn(
        "hazard", F.when(F.col("wi") != 7, F.when(F.col("hazard") > 15, F.col("hazard")).otherwise(F.lit(0.0))))
    records = losses(t).filter("loss_usd is not null")
    return diagnose_zero_weight(records, cells, "rec_id", "mask", "hazard", "asset").groupBy("diagnosis", "avoidable").agg(n_rows())


@query("q12_audit_validation", f"""WITH {fr.WEIGHTS}, {PAID}
SELECT status, count(*) AS n, CAST(0 AS BIGINT) AS n_over_limit, {R("max(CASE status WHEN 'missing_loss' THEN NULL WHEN 'allocated' THEN 0.0 ELSE 1.0 END)")} AS max_error FROM summary GROUP BY 1""")
def _(t):
    return _rounded(quality.validate_audit(audit(t), ["rec_id", "status", "loss_usd", "conservation_error"]))


KM = 111.195  # Fixed value: kilometres of a degree.


@query("q13_footprint_hits", f"""WITH {fr.POINTS}, dist AS ({SQL["j22_outline_distance"]})
SELECT basin, count(*) AS n, {R(f'avg(CAST(distance * {KM}::DOUBLE <= 25 AS INTEGER))')} AS hit_rate FROM points JOIN dist USING (event_id) GROUP BY 1""")
def _(t):
    """Track points and the distance to the outline of their own unit."""
    distances = QUERIES["j22_outline_distance"](t.spark, t.folder).withColumn("km", F.col("distance") * KM)
    return _rounded(external.distance_hits(fr.points(t).select("event_id", "basin").join(distances, "event_id"), "km", ["basin"]))


@query("q14_rain_agreement", f"""WITH {WINDOW_EVENTS}, d AS (SELECT event, "day", sum(ours) AS ours, sum(theirs) AS theirs FROM dm GROUP BY 1, 2),
e AS (SELECT event, wi, wj, sum(ours) AS a, sum(theirs) AS b FROM dm GROUP BY ALL),
m AS (SELECT event, a >= quantile_cont(a, 0.8) OVER w AS ta, b >= quantile_cont(b, 0.8) OVER w AS tb FROM e WINDOW w AS (PARTITION BY event)),
o AS (SELECT event, count(*) FILTER (ta AND tb) / count(*) FILTER (ta OR tb) AS iou, count(*) FILTER (ta AND tb) / count(*) FILTER (ta) AS recall FROM m GROUP BY 1)
SELECT event, count(*) AS n_days, {R('sum(ours)', 4)} AS total_ours, {R('sum(theirs)', 4)} AS total_theirs, {R('sum(ours) - sum(theirs)', 4)} AS bias, {R('max(iou)')} AS iou, {R('max(recall)')} AS recall FROM d JOIN o USING (event) GROUP BY 1""")
def _(t):
    means = external.event_day_means(window_events(t), "event", "day", ["ours", "theirs"], "step")
    got = external.rain_agreement(means, "event", "day", "ours", "theirs", 0.2)
    return got.select("event", "n_days", *[rounded(c, 4).alias(c) for c in ("total_ours", "total_theirs", "bias")], rounded("iou").alias("iou"), rounded("recall").alias("recall"))


@query("q15_flood_link_rates", f"""WITH {FLOODS}, {SHIP_EVENTS}, l AS ({LINKED}),
s AS (SELECT DISTINCT event_key FROM l WHERE main_cause = ' Tropical Cyclone'), h AS (SELECT DISTINCT event_key FROM l WHERE main_cause <> 'Dam break')
SELECT CASE WHEN grouping("year") = 1 THEN 'ALL' ELSE CAST("year" AS VARCHAR) END AS year_label, count(*) AS n_events, count(s.event_key) AS n_strict, {R('count(s.event_key) / count(*)')} AS rate_strict,
       count(h.event_key) AS n_hydromet, {R('count(h.event_key) / count(*)')} AS rate_hydromet FROM evts LEFT JOIN s USING (event_key) LEFT JOIN h USING (event_key) GROUP BY ROLLUP ("year")""")
def _(t):
    events = ship_events(t)
    links = {"strict": external.link_floods(events, floods(t), external.STRICT_CAUSES),
             "hydromet": external.link_floods(events, floods(t), external.HYDROMET_CAUSES)}
    return _rounded(external.link_rates(events, links, "event_key", "year"))


CASES = f"""{WINDOW_EVENTS}, cd AS (SELECT event, "day", sum(ours) AS a, sum(theirs) AS b FROM dm GROUP BY 1, 2), cg AS (SELECT event, wi, wj, sum(ours) AS a, sum(theirs) AS b FROM dm GROUP BY ALL),
cm AS (SELECT *, a >= quantile_cont(a, 0.9) OVER w AS ta, b >= quantile_cont(b, 0.9) OVER w AS tb FROM cg WINDOW w AS (PARTITION BY event)),
co AS (SELECT event, count(*) FILTER (ta AND tb) / count(*) FILTER (ta OR tb) AS iou, count(*) FILTER (ta AND tb) / count(*) FILTER (ta) AS recall,
       CASE WHEN count(*) >= 3 AND stddev_pop(a) > 0 AND stddev_pop(b) > 0 THEN corr(a, b) END AS corr FROM cm GROUP BY 1),
cx AS (SELECT event, "day" AS x FROM cd QUALIFY row_number() OVER (PARTITION BY event ORDER BY a DESC, "day") = 1), cy AS (SELECT event, "day" AS y FROM cd QUALIFY row_number() OVER (PARTITION BY event ORDER BY b DESC, "day") = 1),
ct AS (SELECT event, abs(sum(a) - sum(b)) / greatest(abs(sum(b)), 1e-6) AS bias FROM cd GROUP BY 1),
c AS (SELECT event, x - y AS lag, iou, recall, corr, bias FROM co JOIN cx USING (event) JOIN cy USING (event) JOIN ct USING (event)),
f AS (SELECT *, iou < 0.05::DOUBLE AND recall < 0.10::DOUBLE AS f1, coalesce(corr <= 0 AND bias > 0.5::DOUBLE, FALSE) AS f2, abs(lag) > 3 AS w1, iou >= 0.05::DOUBLE AND iou < 0.15::DOUBLE AS w2, coalesce(corr > 0 AND corr < 0.3::DOUBLE, FALSE) AS w3 FROM c)"""


def cases(t):
    """Metrics of every event's two rain windows."""
    means = external.event_day_means(window_events(t), "event", "day", ["ours", "theirs"], "step")
    return external.case_metrics(means, "event", "day", "ours", "theirs")


def judged_cases(t):
    metrics = cases(t)
    status, reasons = external.case_status(F.col("peak_lag"), F.col("iou"), F.col("recall"), F.col("corr"), F.col("bias_ratio"))
    return metrics.select("event", status.alias("status"), reasons.alias("reasons"))


@query("q16_case_metrics", f"""WITH {CASES}
SELECT event, CAST(lag AS BIGINT) AS peak_lag, {R('iou')} AS iou, {R('recall')} AS recall, {R('corr')} AS corr, {R('bias')} AS bias_ratio FROM c""")
def _(t):
    return _rounded(cases(t).select("event", big("peak_lag").alias("peak_lag"), "iou", "recall", "corr", "bias_ratio"))


@query("q16_case_status", f"""WITH {CASES}
SELECT event, CASE WHEN f1 OR f2 THEN 'FAIL' WHEN w1 OR w2 OR w3 THEN 'WARN' ELSE 'PASS' END AS status,
  CASE WHEN f1 OR f2 THEN concat_ws(';', CASE WHEN f2 THEN 'hazard_proxy_mismatch' END, CASE WHEN f1 THEN 'spatial_displacement' END)
       WHEN w1 OR w2 OR w3 THEN concat_ws(';', CASE WHEN w3 THEN 'hazard_proxy_mismatch' END, CASE WHEN w2 THEN 'spatial_displacement' END, CASE WHEN w1 THEN 'temporal_mismatch' END) ELSE 'none' END AS reasons FROM f""")
def _(t):
    return judged_cases(t)


@query("q16_case_stage", f"""WITH {CASES},
k AS (SELECT c_custkey, c_acctbal, CASE WHEN f1 OR f2 THEN 'FAIL' WHEN w1 OR w2 OR w3 THEN 'WARN' ELSE 'PASS' END AS status, c_nationkey, translate(left(c_mktsegment, 1), 'ABFHM', 'ABCDD') AS grade
  FROM f JOIN customer ON c_custkey = event WHERE 2000 + c_nationkey <= 2020 AND c_acctbal > 0 AND c_mktsegment <> 'BUILDING'),
r AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, strpos('ABCD', grade), c_custkey) <= 4)
SELECT CAST(c_nationkey AS BIGINT) AS nation, count(*) AS n_cases, CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' WHEN bool_or(status = 'WARN') OR count(*) < 3 THEN 'WARN' ELSE 'PASS' END AS stage_status FROM r GROUP BY 1""")
def _(t):
    """Customers whose key is an event's are its records; their best cases by nation are judged by the event's own metrics."""
    metrics = judged_cases(t).select(F.col("event").alias("c_custkey"), "status")
    events = t.customer.select("c_custkey", (F.lit(2000) + F.col("c_nationkey")).alias("year"), F.col("c_acctbal").alias("loss_usd"), big("c_nationkey").alias("nation"),
                               F.translate(F.substring("c_mktsegment", 1, 1), "ABFHM", "ABCDD").alias("grade"),
                               F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).otherwise(" ").alias("selected_storms"))
    candidates = external.case_candidates(events, metrics, ["c_custkey"])
    best = external.rank_cases(candidates, "loss_usd", "grade", "c_custkey", 4, by=["nation"])
    return external.case_stage_status(best, by=["nation"]).select("nation", "n_cases", "stage_status")


@query("q17_release_decision", """
WITH s AS (SELECT n_name, 'L' || (l_linenumber - 1) AS level, max(CASE WHEN l_extendedprice > 104800 THEN 3 WHEN l_extendedprice > 104400 THEN 2 ELSE 1 END) AS r
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2)
SELECT n_name, CASE WHEN bool_or(r = 3 AND level IN ('L0', 'L1', 'L4', 'L5')) THEN 'No Go' WHEN bool_or(r = 2) THEN 'Conditional Go' ELSE 'Go' END AS decision FROM s GROUP BY 1""")
def _(t):
    rows = (t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
            .withColumn("level", F.concat(F.lit("L"), (F.col("l_linenumber") - 1).cast("string"))))
    levels = rows.groupBy("n_name", "level").agg(st.worst(st.above(F.col("l_extendedprice"), 104800.0, 104400.0)).alias("status"))
    return levels.groupBy("n_name").agg(st.release_decision(F.col("level"), F.col("status")).alias("decision"))


@query("q18_golden_numbers", f"""
WITH a AS (SELECT l_returnflag AS metric, avg(l_quantity) AS v FROM lineitem GROUP BY 1)
SELECT m AS metric, e AS expected, {R('v')} AS actual, CAST(coalesce(abs(v - e) <= 0.3, FALSE) AS BIGINT) AS passed FROM (VALUES ('A', 25.5::DOUBLE), ('N', 20.0::DOUBLE), ('R', 25.5::DOUBLE), ('X', 1.0::DOUBLE)) AS g(m, e) LEFT JOIN a ON metric = m""")
def _(t):
    actual = t.lineitem.groupBy(F.col("l_returnflag").alias("metric")).agg(F.avg("l_quantity").alias("value"))
    expected = t.spark.createDataFrame([("A", 25.5, 0.3), ("N", 20.0, 0.3), ("R", 25.5, 0.3), ("X", 1.0, 0.3)], "metric string, value double, tolerance double")
    got = quality.golden_check(actual, expected)
    return got.select("metric", "expected", rounded("actual").alias("actual"), big("passed").alias("passed"))


@query("q19_yearly_counts", """
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS "day", count(DISTINCT user_id) AS n_storms, count(*) AS n_points FROM events GROUP BY 1""")
def _(t):
    return t.events.groupBy(F.col("ts").cast("date").cast("string").alias("day")).agg(
        F.countDistinct("user_id").alias("n_storms"), F.count(F.lit(1)).alias("n_points"))


@query("q20_summary_report", f"""WITH {fr.PANEL}
SELECT count(*) AS n_pairs, count(DISTINCT nation) AS n_nations, CAST(min("year") AS BIGINT) AS first_year, CAST(max("year") AS BIGINT) AS last_year, {R('max(gdp)', 2)} AS max_gdp,
  count(*) FILTER (gdp < 100000) AS n_small FROM panel""")
def _(t):
    return fr.panel(t).agg(F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("nation").alias("n_nations"), big(F.min("year")).alias("first_year"),
                           big(F.max("year")).alias("last_year"), rounded(F.max("gdp"), 2).alias("max_gdp"), F.count_if(F.col("gdp") < 100000).alias("n_small"))


DENOMINATORS = f"""{fr.PANEL}, lk AS (SELECT CAST(n_nationkey AS BIGINT) AS zone, upper(n_name) AS iso3 FROM nation),
w AS (SELECT CAST(c_nationkey AS BIGINT) AS zone, sum(CAST(greatest(c_acctbal, 0) AS DECIMAL(18,2))) AS d FROM customer WHERE c_nationkey % 5 <> 0 GROUP BY 1),
den AS (SELECT lk.zone, lk.iso3, CAST(y AS BIGINT) AS "year", coalesce(CAST(w.d AS DOUBLE), 0) AS denominator, coalesce(p.gdp, 0) AS total, CAST(p.gdp IS NULL AS INTEGER) AS is_missing,
  coalesce(CAST(w.d AS DOUBLE), 0) <= 0 AND coalesce(p.gdp, 0) > 0 AS positive_with_zero_denominator
  FROM lk, range(1991, 1999) AS r(y) LEFT JOIN w ON w.zone = lk.zone LEFT JOIN panel p ON p.nation = lk.zone AND p."year" = y)"""


def denominators(t):
    """Weights of the nations (some have none) beside their yearly totals (some are missing)."""
    weights = t.customer.filter("c_nationkey % 5 <> 0").groupBy(big("c_nationkey").alias("zone")).agg(
        F.sum(F.greatest("c_acctbal", F.lit(0.0)).cast("decimal(18,2)")).cast("double").alias("denominator"))
    lookup = t.nation.select(big("n_nationkey").alias("zone"), F.upper("n_name").alias("iso3"))
    years = lookup.select("zone", F.explode(F.sequence(F.lit(1991), F.lit(1998))).alias("year"))
    totals = fr.panel(t).select(F.col("nation").alias("zone"), "year", F.col("gdp").alias("total"))
    return quality.denominator_table(years.join(weights, "zone", "left"), totals, lookup)


@query("q20_denominator_table", f"""WITH {DENOMINATORS}
SELECT zone, iso3, "year", {R('denominator', 2)} AS denominator, {R('total', 2)} AS total, is_missing, positive_with_zero_denominator FROM den""")
def _(t):
    return _rounded(denominators(t), 2, year=big("year"))


@query("q20_zero_denominator_log", f"""WITH {DENOMINATORS}
SELECT zone, iso3, "year", 'zero_denominator' AS log FROM den WHERE positive_with_zero_denominator UNION ALL SELECT zone, iso3, "year", 'missing_total' FROM den WHERE is_missing = 1""")
def _(t):
    return quality.denominator_logs(denominators(t)).select("zone", "iso3", big("year").alias("year"), "log")


@query("q20_qa_summary", f"""WITH {DENOMINATORS}, y AS (SELECT "year", sum(CASE WHEN denominator > 0 THEN total ELSE 0 END) AS s, sum(total) AS g FROM den GROUP BY 1)
SELECT (SELECT CAST(min("year") AS BIGINT) FROM den) AS first_year, (SELECT CAST(max("year") AS BIGINT) FROM den) AS last_year, {R('avg(abs(s - g) / nullif(g, 0))')} AS mean_total_rel_error,
  {R('max(abs(s - g) / nullif(g, 0))')} AS max_total_rel_error, (SELECT count(*) FROM den WHERE is_missing = 1) AS missing_count, (SELECT count(*) FROM den WHERE positive_with_zero_denominator) AS zero_denominator_count FROM y""")
def _(t):
    den = denominators(t)
    spread = den.withColumn("spread", F.when(F.col("denominator") > 0, F.col("total")).otherwise(F.lit(0.0)))
    return _rounded(quality.qa_summary(spread, "spread"), first_year=big("first_year"), last_year=big("last_year"))


@query("q21_denoise_counters", f"""WITH {fr.GRID},
x AS (SELECT *, signed * 100 AS v, 90 - ("row" + 0.5) * 180 / m AS lat FROM grid, (SELECT max("row") + 1 AS m FROM grid)),
h AS (SELECT CASE WHEN count(v) FILTER (v > 0 AND abs(lat) >= 45) < 1000 THEN 'infinity'::DOUBLE ELSE avg(v) FILTER (v > 0 AND abs(lat) >= 45) + 3 * stddev_pop(v) FILTER (v > 0 AND abs(lat) >= 45) END AS th FROM x)
SELECT coalesce(CASE WHEN v < 0 THEN 'negative' WHEN v > 0 AND v < 0.3 THEN 'low' WHEN abs(lat) >= 45 AND v > th THEN 'high_latitude' END, 'kept') AS rule, count(*) AS n,
  {R("sum(CASE WHEN NOT (v < 0 OR (v > 0 AND v < 0.3) OR (abs(lat) >= 45 AND v > th)) THEN v ELSE 0 END)", 4)} AS total FROM x, h GROUP BY 1""")
def _(t):
    g = fr.grid(t).withColumn("v", F.col("signed") * 100)
    sized = with_scalars(g, g.agg((F.max("row") + 1).alias("m"))).withColumn("lat", 90 - (F.col("row") + 0.5) * 180 / F.col("m"))
    limit = raster.high_latitude_threshold(sized, F.col("lat"), "v").select("threshold")
    value, rule = raster.denoised(F.col("v"), F.col("lat"), F.col("threshold"))
    return with_scalars(sized, limit).groupBy(F.coalesce(rule, F.lit("kept")).alias("rule")).agg(n_rows(), rounded(F.sum(value), 4).alias("total"))


@query("q21_denoise_by_group", f"""WITH {fr.GRID},
x AS (SELECT *, signed * 100 AS v, 90 - ("row" + 0.5) * 180 / m AS lat FROM grid, (SELECT max("row") + 1 AS m FROM grid)),
h AS (SELECT zone, count(v) FILTER (v > 0 AND abs(lat) >= 45) AS k, avg(v) FILTER (v > 0 AND abs(lat) >= 45) + 1.5 * stddev_pop(v) FILTER (v > 0 AND abs(lat) >= 45) AS th FROM x GROUP BY 1),
r AS (SELECT x.*, CASE WHEN v < 0 THEN 'negative' WHEN v > 0 AND v < 0.3 THEN 'low' WHEN abs(lat) >= 45 AND k >= 100 AND v > th THEN 'high_latitude' END AS rule FROM x JOIN h USING (zone))
SELECT zone, count(*) AS n_cells, count(*) FILTER (rule = 'negative') AS n_negative, count(*) FILTER (rule = 'low') AS n_low, count(*) FILTER (rule = 'high_latitude') AS n_high_latitude,
  {R("coalesce(sum(v) FILTER (rule IS NULL), 0)", 4)} AS total, {R("coalesce(sum(v) FILTER (rule IS NULL), 0)", 4)} AS layer_total FROM r GROUP BY 1""")
def _(t):
    """Each group (a year in the source) has its own threshold; its counters come from the pass that writes the layer."""
    g = fr.grid(t).withColumn("v", F.col("signed") * 100)
    sized = with_scalars(g, g.agg((F.max("row") + 1).alias("m"))).withColumn("lat", 90 - (F.col("row") + 0.5) * 180 / F.col("m"))
    limits = raster.high_latitude_threshold(sized, F.col("lat"), "v", sigmas=1.5, min_count=100, by=["zone"])
    table, written = scratch_table(t, "q21_layer"), raster.write_denoised(sized.join(limits, "zone"), "v", F.col("lat"), "zone")
    counted = written(table)
    layer = t.spark.table(table).groupBy("zone").agg(rounded(F.coalesce(F.sum("v"), F.lit(0.0)), 4).alias("layer_total"))
    facts = t.spark.createDataFrame([(z, *c) for z, c in counted.items()], "zone long, n_cells long, n_negative long, n_low long, n_high_latitude long, total double")
    return layer.join(F.broadcast(facts), "zone").withColumn("total", rounded("total", 4))


FOOTPRINTS = f"""track_km AS ({SQL["j22_track_outline_km"]}), fe AS (SELECT storm_id AS k, storm_id % 25 AS iso, km FROM track_km),
fp AS (SELECT DISTINCT o_custkey AS k, o_orderkey % 25 AS iso FROM orders),
fm AS (SELECT count(*) FILTER (k IN (SELECT k FROM fp)) / count(*) AS i, count(*) FILTER (EXISTS (SELECT 1 FROM fp WHERE fp.k = fe.k AND fp.iso = fe.iso)) / count(*) AS p,
              avg(CAST(km <= 25 AS INTEGER)) AS h, quantile_cont(km, 0.95) AS d FROM fe),
fv AS (SELECT *, CASE WHEN i < 0.6 OR p < 0.4 THEN 'FAIL' WHEN h < 0.5 OR d > 500 THEN 'WARN' ELSE 'PASS' END AS footprint_status FROM fm)"""


def footprints(t):
    """Verdict on storms (their tracks' distance to the outline of their unit) and the footprints known by number and unit."""
    events = QUERIES["j22_track_outline_km"](t.spark, t.folder).select(
        F.col("storm_id").alias("disno"), (F.col("storm_id") % 25).alias("iso"), F.lit(2024).alias("year"), "km")
    events = save_table(events, scratch_table(t, "footprint_km"))
    prints = t.orders.select(F.col("o_custkey").alias("disno"), (F.col("o_orderkey") % 25).alias("iso"))
    rates = external.footprint_matches(events, prints).filter("year_label = 'ALL'").select("id_rate", "pair_rate")
    hits = external.distance_hits(events, "km", []).select("hit_rate")
    p95 = exact_quantiles(events, [], "km", {"p95_km": 0.95})
    return external.footprint_verdict(with_scalars(with_scalars(rates, hits), p95))


@query("q13_footprint_verdict", f"""WITH {FOOTPRINTS}
SELECT {R('i')} AS id_rate, {R('p')} AS pair_rate, {R('h')} AS hit_rate, {R('d', 4)} AS p95_km, footprint_status AS status,
  concat_ws(';', CASE WHEN i < 0.6 THEN 'id_match_rate_low' END, CASE WHEN p < 0.4 THEN 'pair_match_rate_low' END) AS fail_reasons,
  concat_ws(';', CASE WHEN h < 0.5 THEN 'hit_rate_low' END, CASE WHEN d > 500 THEN 'distance_p95_high' END) AS warn_reasons FROM fv""")
def _(t):
    return _rounded(footprints(t), p95_km=rounded("p95_km", 4))


@query("q14_sample_rain_metrics", f"""WITH {fr.GRID}, c AS (SELECT "row", "value" AS a, CASE WHEN "col" % 9 <> 4 THEN signed END AS b, CASE WHEN "row" % 2 = 0 THEN "col" % 3 END AS k FROM grid),
p AS (SELECT *, CASE WHEN b IS NOT NULL THEN a END AS pa FROM c),
m AS (SELECT *, coalesce(pa >= quantile_cont(pa, 0.9) OVER w, FALSE) AS a1, coalesce(b >= quantile_cont(b, 0.9) OVER w, FALSE) AS b1,
             coalesce(pa >= quantile_cont(pa, 0.8) OVER w, FALSE) AS a2, coalesce(b >= quantile_cont(b, 0.8) OVER w, FALSE) AS b2 FROM p WINDOW w AS (PARTITION BY "row"))
SELECT "row", CASE WHEN count(k) > 0 THEN {R('avg(CAST(k > 0 AS INTEGER))')} ELSE {R('avg(CAST(b IS NOT NULL AS INTEGER))')} END AS coverage, count(b) AS n, {R('avg(pa - b)')} AS bias, {R('avg(abs(pa - b))')} AS mae,
  {R('sqrt(avg((pa - b) * (pa - b)))')} AS rmse, {R('max(abs(pa - b))')} AS max_abs, {R('corr(pa, b)')} AS corr,
  {R('count(*) FILTER (a1 AND b1) / count(*) FILTER (a1 OR b1)')} AS top10, {R('count(*) FILTER (a2 AND b2) / count(*) FILTER (a2 OR b2)')} AS top20 FROM m GROUP BY 1""")
def _(t):
    cells = fr.grid(t).withColumn("b", F.when(F.col("col") % 9 != 4, F.col("signed"))).withColumn(
        "k", F.when(F.col("row") % 2 == 0, F.col("col") % 3))
    return _rounded(external.sample_rain_metrics(cells, ["row"], "value", "b", "k"))


# Core years, and the last year of rain data, in the years of the orders.
CORE, LAST_RAIN = (1995, 1996), 1998
SAMPLES = f"""{fr.GRID}, c AS (SELECT "row", "value" AS a, CASE WHEN "col" % 9 <> 4 THEN signed END AS b, CASE WHEN "col" % 5 <> 1 THEN abs(signed) * 10 END AS err FROM grid),
p AS (SELECT *, CASE WHEN b IS NOT NULL THEN a END AS pa FROM c),
m AS (SELECT *, coalesce(pa >= quantile_cont(pa, 0.9) OVER w, FALSE) AS a1, coalesce(b >= quantile_cont(b, 0.9) OVER w, FALSE) AS b1,
             coalesce(pa >= quantile_cont(pa, 0.8) OVER w, FALSE) AS a2, coalesce(b >= quantile_cont(b, 0.8) OVER w, FALSE) AS b2 FROM p WINDOW w AS (PARTITION BY "row")),
smp AS (SELECT "row", 1995 + "row" % 3 AS "year", avg(CAST(b IS NOT NULL AS INTEGER)) AS coverage, corr(pa, b) AS corr, avg(pa - b) AS bias, sqrt(avg((pa - b) * (pa - b))) AS rmse,
  count(*) FILTER (a1 AND b1) / count(*) FILTER (a1 OR b1) AS top10, count(*) FILTER (a2 AND b2) / count(*) FILTER (a2 OR b2) AS top20, quantile_cont(err, 0.5) AS e50, quantile_cont(err, 0.95) AS e95 FROM m GROUP BY 1),
smy AS (SELECT "year", quantile_cont(corr, 0.5) AS corr, quantile_cont(top10, 0.5) AS top10, quantile_cont(top20, 0.5) AS top20, count(*) AS n FROM smp WHERE "year" IN {CORE} GROUP BY 1),
smed AS (SELECT quantile_cont(corr, 0.5) AS mc, quantile_cont(top10, 0.5) AS m10, quantile_cont(top20, 0.5) AS m20, coalesce(sum(n), 0) AS n FROM smy)"""
RAIN_DAYS = f"""od AS (SELECT DISTINCT year(o_orderdate) AS y, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderpriority LIKE '1%' OR year(o_orderdate) <> 1996),
cov AS (SELECT y.v AS y, count(d) / dayofyear(make_date(y.v, 12, 31)) AS coverage, CASE WHEN count(d) > 0 THEN 1.0 END AS readable FROM (VALUES ({CORE[0]}), ({CORE[1]})) AS y(v) LEFT JOIN od ON od.y = y.v GROUP BY y.v)"""


def rain_samples(t):
    """Per-sample rain metrics with the year of each sample."""
    col = F.col("col")
    cells = fr.grid(t).withColumns({"b": F.when(col % 9 != 4, F.col("signed")), "err": F.when(col % 5 != 1, F.abs("signed") * 10)})
    return external.sample_rain_metrics(cells, ["row"], "value", "b", error="err").withColumn("year", F.lit(1995) + F.col("row") % 3)


def core_coverage(t):
    """Daily coverage of the core years."""
    kept = F.col("o_orderpriority").startswith("1") | (F.year("o_orderdate") != 1996)
    days = t.orders.filter(kept).select(F.col("o_orderdate").cast("date").alias("day"))
    years = t.region.select(F.explode(F.array(*[F.lit(y) for y in CORE])).alias("year"))
    return external.daily_coverage(days, "day", years)


@query("q14_yearly_convergence", f"""WITH {SAMPLES}
SELECT "year", count(*) AS n_samples, {R('quantile_cont(coverage, 0.5)')} AS coverage, {R('quantile_cont(corr, 0.5)')} AS corr, {R('avg(bias)')} AS bias, {R('avg(rmse)')} AS rmse,
  {R('quantile_cont(top10, 0.5)')} AS top10, {R('quantile_cont(top20, 0.5)')} AS top20, {R('quantile_cont(e50, 0.5)')} AS error_p50, {R('quantile_cont(e95, 0.5)')} AS error_p95 FROM smp GROUP BY 1""")
def _(t):
    return _rounded(external.yearly_sample_metrics(rain_samples(t), "year"), year=big("year"))


@query("q14_rain_verdict", f"""WITH {WINDOW_EVENTS}, {SAMPLES}, {RAIN_DAYS}, {FOOTPRINTS}, d AS (SELECT event, "day", sum(ours) AS a, sum(theirs) AS b FROM dm GROUP BY 1, 2),
x AS (SELECT event, "day" FROM d QUALIFY row_number() OVER (PARTITION BY event ORDER BY a DESC, "day") = 1), y AS (SELECT event, "day" FROM d QUALIFY row_number() OVER (PARTITION BY event ORDER BY b DESC, "day") = 1),
l AS (SELECT quantile_cont(abs(x."day" - y."day"), 0.5) AS lag, count(*) AS n FROM x JOIN y USING (event)), e AS (SELECT corr(a, b) AS ec FROM (SELECT sum(a) AS a, sum(b) AS b FROM d GROUP BY event)),
f AS (SELECT smed.*, lag, l.n AS ne, ec, (SELECT min(coverage) FROM cov) AS mcov, (SELECT min(readable) FROM cov) AS mread, (SELECT count(*) FROM orders WHERE o_orderdate IS NULL) AS missing,
    (SELECT count(DISTINCT year(o_orderdate)) FROM orders WHERE year(o_orderdate) <= {LAST_RAIN} AND year(o_orderdate) NOT IN {CORE}) AS ext,
    (SELECT count(DISTINCT year(o_orderdate)) FROM orders WHERE year(o_orderdate) > {LAST_RAIN}) AS beyond, (SELECT footprint_status FROM fv) AS footprint FROM smed, l, e),
v AS (SELECT *, concat_ws(';', CASE WHEN mcov < 0.95 THEN 'imerg_daily_file_coverage_rate_low' END, CASE WHEN mread < 1 THEN 'imerg_variable_readability_rate_low' END, CASE WHEN mcov IS NULL THEN 'imerg_core_coverage_missing' END,
    CASE WHEN mc <= 0 AND m10 < 0.05 THEN 'imerg_rainfall_convergence_failure' END, CASE WHEN ec <= 0 AND lag > 3 THEN 'imerg_event_scale_failure' END, CASE WHEN missing > 0 THEN 'missing_imerg_project_inputs' END) AS fails,
  concat_ws(';', CASE WHEN mcov >= 0.95 AND mcov < 1 THEN 'imerg_daily_file_coverage_partial' END, CASE WHEN mc > 0 AND mc < 0.3 THEN 'imerg_rainfall_corr_low' END, CASE WHEN m20 < 0.15 THEN 'imerg_top20_overlap_low' END,
    CASE WHEN n = 0 THEN 'imerg_sample_metrics_empty' END, CASE WHEN ec > 0 AND ec < 0.3 THEN 'imerg_event_total_rainfall_corr_low' END, CASE WHEN lag > 1 THEN 'imerg_event_peak_day_lag_high' END,
    CASE WHEN ne = 0 THEN 'imerg_event_metrics_empty' END, CASE WHEN ext > 0 THEN 'extended_rainfall_only_years_present' END, CASE WHEN beyond > 0 THEN 'years_not_evaluable_by_current_external_datasets' END) AS warns FROM f)
SELECT {R('mcov')} AS min_coverage, {R('mc')} AS median_corr, {R('m10')} AS median_top10, {R('m20')} AS median_top20, {R('ec')} AS event_corr, {R('lag')} AS median_lag, CASE WHEN fails <> '' THEN 'FAIL' WHEN warns <> '' THEN 'WARN' ELSE 'PASS' END AS status,
  fails AS fail_reasons, warns AS warn_reasons, CASE WHEN fails <> '' OR footprint = 'FAIL' THEN 'FAIL' WHEN warns <> '' OR footprint = 'WARN' THEN 'WARN' ELSE 'PASS' END AS overall FROM v""")
def _(t):
    means = external.event_day_means(window_events(t), "event", "day", ["ours", "theirs"], "step")
    events = external.rain_agreement(means, "event", "day", "ours", "theirs").select("total_ours", "total_theirs", "peak_lag")
    events = save_table(events, scratch_table(t, "q14_events"))
    rows = events.agg(stats.safe_corr(F.col("total_ours"), F.col("total_theirs")).alias("event_corr"), F.count(F.lit(1)).alias("n_events"))
    rows = with_scalars(rows, exact_quantiles(events.select(F.abs("peak_lag").alias("lag")), [], "lag", {"median_lag": 0.5}))
    yearly = save_table(external.yearly_sample_metrics(rain_samples(t).filter(F.col("year").isin(*CORE)), "year"), scratch_table(t, "q14_yearly"))
    rows = with_scalars(rows, yearly.agg(F.coalesce(F.sum("n_samples"), F.lit(0)).alias("n_samples")))
    rows = with_scalars(rows, exact_quantiles_of(yearly, [], {f"median_{c}": (c, 0.5) for c in ("corr", "top10", "top20")}))
    rows = with_scalars(rows, core_coverage(t).agg(F.min("coverage").alias("min_coverage"), F.min("readable").alias("min_readable")))
    year = F.year("o_orderdate")
    later = F.when((year <= LAST_RAIN) & ~year.isin(*CORE), year)
    rows = with_scalars(rows, t.orders.agg(F.count_if(F.col("o_orderdate").isNull()).alias("missing_inputs"), F.count_distinct(later).alias("extended_years"),
                                           F.count_distinct(F.when(year > LAST_RAIN, year)).alias("not_evaluable_years")))
    rows = with_scalars(rows, footprints(t).select(F.col("status").alias("footprint")))
    judged = external.rain_verdict(rows)
    overall = external.overall_status(F.col("footprint"), F.col("status"), F.col("extended_years"), F.col("not_evaluable_years"))
    shown = ("min_coverage", "median_corr", "median_top10", "median_top20", "event_corr", "median_lag")
    return judged.select(*[rounded(c).alias(c) for c in shown], "status", "fail_reasons", "warn_reasons", overall.alias("overall"))


@query("q15_flood_link_verdict", f"""WITH {FLOODS}, {SHIP_EVENTS}, l AS ({LINKED}), ov AS ({SQL["a36_flood_overlap"]}),
t AS (SELECT DISTINCT event_key FROM l WHERE main_cause = ' Tropical Cyclone'), r AS (SELECT "year", count(t.event_key) / count(*) AS rate FROM evts LEFT JOIN t USING (event_key) GROUP BY 1),
m AS (SELECT "year", quantile_cont(flooded_ratio, 0.5) AS mo, quantile_cont(duration_corr, 0.5) AS mc FROM evts JOIN t USING (event_key) JOIN ov ON storm_id = event_key GROUP BY 1)
SELECT CAST("year" AS VARCHAR) AS year_label, {R('rate')} AS rate_strict, {R('mo')} AS median_overlap, {R('mc')} AS median_corr,
  CASE WHEN rate < 0.01 OR coalesce(mo < 0.05 AND mc <= 0, FALSE) THEN 'FAIL' WHEN mo IS NULL THEN 'WARN' ELSE 'PASS' END AS status FROM r LEFT JOIN m USING ("year")""")
def _(t):
    """The medians are those of the flood samples of the linked events (of the storms of their number)."""
    events = ship_events(t)
    strict = external.link_floods(events, floods(t), external.STRICT_CAUSES)
    rates = external.link_rates(events, {"strict": strict}, "event_key", "year").filter("year_label <> 'ALL'")
    samples = QUERIES["a36_flood_overlap"](t.spark, t.folder).withColumnRenamed("storm_id", "event_key")
    linked = events.join(strict.select("event_key"), "event_key").join(samples, "event_key").withColumn("year_label", F.col("year").cast("string"))
    medians = exact_quantiles_of(linked, ["year_label"], {"median_overlap": ("flooded_ratio", 0.5), "median_corr": ("duration_corr", 0.5)})
    judged = external.flood_link_verdict(rates.join(medians, "year_label", "left"))
    return _rounded(judged.select("year_label", "rate_strict", "median_overlap", "median_corr", "status"))


@query("q16_footprint_case_verdict", f"""WITH {CASES}, track_km AS ({SQL["j22_track_outline_km"]}), cj AS (SELECT c.*, km FROM c LEFT JOIN track_km ON storm_id = event),
g AS (SELECT *, coalesce(km > 500, FALSE) AS g1, iou < 0.05::DOUBLE AND recall < 0.10::DOUBLE AS g2 FROM cj)
SELECT event, CASE WHEN g1 OR g2 THEN 'FAIL' WHEN abs(lag) > 3 OR coalesce(km > 100, FALSE) OR iou < 0.10::DOUBLE THEN 'WARN' ELSE 'PASS' END AS status,
  concat_ws(';', CASE WHEN g1 THEN 'distance_too_large' END, CASE WHEN g2 THEN 'overlap_too_low' END) AS fail_reasons,
  CASE WHEN g1 OR g2 THEN '' ELSE concat_ws(';', CASE WHEN abs(lag) > 3 THEN 'peak_lag_gt_3d' END, CASE WHEN km > 100 THEN 'distance_gt_100km' END, CASE WHEN iou < 0.10::DOUBLE THEN 'iou_low' END) END AS warn_reasons FROM g""")
def _(t):
    tracks = QUERIES["j22_track_outline_km"](t.spark, t.folder).select(F.col("storm_id").alias("event"), F.col("km").alias("distance_km"))
    metrics = cases(t).withColumnRenamed("peak_lag", "lag").join(tracks, "event", "left")
    return external.footprint_case_verdict(metrics).select("event", "status", "fail_reasons", "warn_reasons")
