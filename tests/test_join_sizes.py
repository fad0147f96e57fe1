"""Rows that joins pass on: they follow the input and not the number of rows that share a value."""

import datetime as dt
import math

from pyspark.sql import functions as F

from squallframe import catalog
from squallframe.catalog import base
from squallframe.catalog import frames as fr
from squallframe.operators import external, fit, keyed, spatial, windows
from squallframe.plans import assets


def most_rows(df, *kinds):
    """The rows collected and the largest number of rows an operator of these kinds passed on."""
    rows = df.collect()

    def walk(node):
        kind = node.nodeName()
        count = node.metrics().get("numOutputRows")
        own = [count.get().value()] if count.isDefined() and any(k in kind for k in kinds) else []
        if kind.startswith("AdaptiveSparkPlan"):
            return own + walk(node.executedPlan())
        if "QueryStage" in kind:
            return own + walk(node.plan())
        return own + [n for i in range(node.children().size()) for n in walk(node.children().apply(i))]
    return rows, max(walk(df._jdf.queryExecution().executedPlan()), default=0)


def test_mask_of_many_records_that_name_one_unit(spark):
    edges = spark.createDataFrame([(u, *map(float, e)) for u in (7, 8) for e in ((0, 0, 9, 0), (9, 0, 9, 9), (9, 9, 0, 9), (0, 9, 0, 0))],
                                  "unit_id long, x1 double, y1 double, x2 double, y2 double")
    points = spark.range(200).select("id", (F.col("id") % 100).alias("rec"), (F.col("id") / 20).alias("x"), (F.col("id") % 9 + 0.5).alias("y"))
    units = spark.range(100).filter("id % 3 < 2").select(F.col("id").alias("rec"), (F.col("id") % 3 + 7).alias("unit_id"))
    rows, most = most_rows(spatial.mask_points(points, units, edges, "rec", "x", "y"), "Join")
    assert {r.id: r.inside for r in rows} == {i: int(i % 100 % 3 < 2 and i / 20 < 9) for i in range(200)}
    # 180 points lie in two outlines of four edges each; 67 records name one of them, a pair of all these would be 6000 rows and more.
    assert most <= 8 * 200


def test_distance_of_a_place_is_found_once(spark):
    folder = "/root/testdata/sf0.01"
    got = catalog.queries()["j22_outline_distance"](spark, folder)
    points = fr.points(base.Tables(spark, folder))
    places = points.select(F.col("storm_id") % 25, "center_lat", "center_lon").distinct().count()
    stored = spark.table(base._SCRATCH[spark.sparkContext.applicationId, "j22_dots_a"])
    assert stored.count() == places < points.count() == got.count()


def test_best_flood_is_sought_among_the_longest_of_each_day(spark):
    day = lambda i: dt.date(2013, 6, 1) + dt.timedelta(days=i)
    events = [(k, "PHL", day(3 + k % 5), day(9 + k % 5)) for k in range(10)]
    floods = [(i, day(i % 4), day(i % 4 + i * 7 % 25), ["PHL"], "Heavy rain") for i in range(100)]
    schema = "flood_id long, began date, ended date, iso_set array<string>, main_cause string"
    rows, most = most_rows(external.link_floods(spark.createDataFrame(events, "event_key long, iso string, pad_start date, pad_end date"),
                                                spark.createDataFrame(floods, schema), external.HYDROMET_CAUSES), "Join")

    def best(start, end):
        met = [(-((min(end, b) - max(start, a)).days + 1), abs((a - start).days), i) for i, a, b, *_ in floods if a <= end and b >= start]
        return min(met)[2]
    assert {r.event_key: r.flood_id for r in rows} == {k: best(a, b) for k, _, a, b in events}
    # Five spans of events, four first days with 25 last days each: of a day's floods those matter that outlast all with smaller ids.
    assert most < 5 * 4 * 25 // 3


def test_anchors_of_one_place_share_their_window(spark):
    anchors = spark.range(300).select("id", (F.col("id") % 3 + 20).alias("row"), F.lit(20).cast("long").alias("col"), (F.col("id") % 2).alias("target"))
    anchors = anchors.unionByName(spark.createDataFrame([(300, None, 20, 1)], anchors.schema))
    zones = spark.range(40).select(F.col("id").alias("row")).crossJoin(spark.range(40).select(F.col("id").alias("col")))
    zones = zones.withColumn("zone", F.col("col") % 2).withColumn("value", F.col("row") + 0.0)
    rows, most = most_rows(windows.zone_share_windows(anchors, zones.select("row", "col", "zone"), size=3, factor=4), "Join")
    assert len(rows) == 301 * 9 and {r.share for r in rows if r.id < 300} == {0.5} and {r.share for r in rows if r.id == 300} == {0.0}
    assert most < 301 * 9
    rows, most = most_rows(windows.extract_windows(anchors.drop("target"), zones.select("row", "col", "value"), method="mean", size=3, factor=4), "Join")
    assert {(r.id, r.wi, r.wj): r.value for r in rows if r.id < 300} == {
        (i, w, j): i % 3 + 20 - 6 + 4 * (2 - w) + 1.5 for i in range(300) for w in range(3) for j in range(3)}
    assert [r.value for r in rows if r.id == 300] == [None] * 9 and most < 301 * 9


def test_unmatched_keys_in_one_aggregate(spark):
    left = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "c"), (4, None)], "k long, l string")
    right = spark.createDataFrame([(2, "b"), (3, "b"), (3, "b"), (None, "c")], "k long, l string")
    got = keyed.unmatched_keys(left, right, ["k", "l"])
    assert sorted((str(r.k), str(r.l), r.only_in) for r in got.collect()) == [
        ("1", "a", "left"), ("3", "b", "right"), ("4", "None", "left"), ("None", "c", "left"), ("None", "c", "right")]
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_fit_iterates_over_distinct_rows(spark, monkeypatch):
    read = []
    plain = fit._normal_equations
    monkeypatch.setattr(fit, "_normal_equations", lambda rows, trials: read.append(rows.count()) or plain(rows, trials))
    sample = spark.range(6000).select((F.col("id") % 2 + 2012).alias("year"), (F.col("id") % 20 * 1.0).alias("x"))
    sample = sample.withColumn("y", 4.0 + 50.0 / (1 + F.exp(-0.9 * (F.col("x") - 9.0))))
    got = {r.scope: r for r in fit.fit_sigmoid_scopes(sample, "year").collect()}
    assert set(read) == {40} and {k: r.n for k, r in got.items()} == {"2012": 3000, "2013": 3000, "combined": 6000}
    assert all(abs(r.d - 9.0) < 1e-6 and r.rmse < 1e-6 and r.r2 > 1 - 1e-9 for r in got.values())
    flat = fit.fit_sigmoid(sample.withColumn("y", F.lit(20.3)))
    assert flat.n == 6000 and flat.r2 != flat.r2


def test_a_point_is_sent_once_for_all_its_days(spark):
    folder = "/root/testdata/sf0.01"
    rows, most = most_rows(catalog.queries()["j8_day_offset_join"](spark, folder), "Join")
    n = fr.points(base.Tables(spark, folder)).count()
    assert len(rows) == 15 * n and most <= n


def test_values_of_the_days_around_a_point(spark):
    day = lambda i: dt.date(1970, 1, 1) + dt.timedelta(days=i)
    days = [*range(-65, 66, 3), -1, 1000]
    grid = spark.createDataFrame([(day(i), k, float(i) if i != 7 else None) for i in days for k in (1, 2)] + [(None, 1, 5.0)], "day date, k int, value double")
    points = [(i, day(i - 60), i % 4) for i in range(121)] + [(200, None, 1), (201, day(0), None), (202, day(0), 1), (202, day(0), 1)]
    got = windows.day_offset_values(spark.createDataFrame(points, "id int, at date, k int"), grid, ["k"], "at", before=4, after=2)
    held = {(day(i), k): float(i) for i in days if i != 7 for k in (1, 2)}
    want = [(i, str(at), o, held.get((at and at + dt.timedelta(days=o), k))) for i, at, k in points for o in range(-4, 3)]
    assert sorted(map(str, [(r.id, str(r["at"]), r.day_offset, r.value) for r in got.collect()])) == sorted(map(str, want))


def test_a_point_is_sent_once_for_each_tile_of_its_square(spark):
    points = spark.createDataFrame([(i, i % 2, i * 0.37 % 11 - 0.5, i * 0.91 % 23 - 1.0) for i in range(300)] + [(300, 0, None, 1.0)], "p int, k int, lat double, lon double")
    nodes = [(k, i, j, i * 100.0 + j) for k in (0, 1) for i in range(20) for j in range(20) if (i + j + k) % 7]
    grid = spark.createDataFrame([*nodes, (0, 3, 3, -1.0)], "k int, lat_idx long, lon_idx long, v double")
    got = windows.coordinate_window(points, grid, "lat", "lon", 1.6, (0.0, 0.5, 20), (0.0, 1.0, 20), ["k"])
    rows, most = most_rows(got, "Generate")
    assert got.columns == ["k", "lat_idx", "lon_idx", "p", "lat", "lon", "wi", "wj", "v"]
    want = []
    for p in points.collect():
        if p["lat"] is not None:
            first = [max(math.ceil((c - 1.6) / s), 0) for c, s in ((p["lat"], 0.5), (p["lon"], 1.0))]
            want += [(p.p, i - first[0], j - first[1], v) for k, i, j, v in [*nodes, (0, 3, 3, -1.0)] if k == p.k
                     and first[0] <= i <= math.floor((p["lat"] + 1.6) / 0.5) and first[1] <= j <= math.floor((p["lon"] + 1.6) / 1.0)]
    assert sorted((r.p, r.wi, r.wj, r.v) for r in rows) == sorted(want)
    assert most <= 4 * 301 < len(want) // 3


def test_layers_of_all_years_meet_once_by_cell(spark):
    light = [(y, r, c, float(r + c + (y or 1) % 3)) for y in (2000, 2001, None) for r in range(6) for c in range(5) if (r + c) % 4 or y == 2001] + [(2000, None, 1, 3.0)]
    people = [(y, r, c, None if r == c else 2.0 * r + 1) for y in (2000, 2001, 2002) for r in range(2, 8) for c in range(4)]
    zones = [(r, c, (-1, 0, 1, 2, None)[(r + 2 * c) % 5]) for r in range(2, 7) for c in range(5)]
    totals = [(2000, 1, 100.0, 0), (2000, 2, 50.0, 0), (2001, 1, 70.0, 0), (2001, 2, 9.0, 1), (2000, -1, 5.0, 0), (2000, 0, 5.0, 0)]
    ddl = "year int, row long, col long, value double"
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        layer = assets.asset_layer(spark.createDataFrame(light, ddl), spark.createDataFrame(people, ddl), spark.createDataFrame(zones, "row long, col long, value long"),
                                   spark.createDataFrame(totals, "year int, country_id long, gdp double, is_missing int"), row_offset=1)
        rows = layer.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    there, zone, paid = {p[:3]: p[3] for p in people}, {z[:2]: z[2] for z in zones}, {t[:2]: t[2] for t in totals if not t[3]}
    weigh = lambda y, r, c, v: (v or 0.0) * (there.get((y, r, c)) or 0.0)
    cells = [(y, None if r is None else r + 1, c, v) for y, r, c, v in light]
    want = []
    for y, r, c, v in cells:
        z = zone.get((r, c))
        whole = sum(weigh(*o) for o in cells if o[0] == y and zone.get(o[1:3]) == z)
        share = paid.get((y, z), 0.0) * weigh(y, r, c, v) / whole if (z or 0) > 0 and whole else 0.0
        want.append((y, r, c, z, there.get((y, r, c)), round(share, 9)))
    assert sorted(map(str, [(r.year, r.row, r["col"], r.zone, r.population, round(r.asset, 9)) for r in rows])) == sorted(map(str, want))
    plan = layer._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("ReusedExchange [row") == 3  # the zone sums read the exchanges of the cells
    assert "hashpartitioning(year#" not in "".join(x for x in plan.splitlines() if "row#" in x)


def test_distances_of_a_footprint_verdict_are_found_once(spark):
    folder = "/root/testdata/sf0.001"
    got = catalog.queries()["q13_footprint_verdict"](spark, folder)
    stored = spark.table(base._SCRATCH[spark.sparkContext.applicationId, "footprint_km"])
    assert stored.count() == base.Tables(spark, folder).events.select("user_id").distinct().count()
    assert "j22_" not in got._jdf.queryExecution().optimizedPlan().toString()  # no branch finds them again
