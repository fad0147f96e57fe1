"""Whole workflows on a small made-up season."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from squallframe import session
from squallframe.plans import assets, attribution


@pytest.fixture(scope="module")
def season(spark):
    day = dt.date(2013, 11, 7)
    tracks = [(1, "HAIYAN", s, day + dt.timedelta(days=s // 2)) for s in range(4)]
    tracks += [(2, "ZORAIDA", s, day + dt.timedelta(days=s)) for s in range(2)]
    track_points = spark.createDataFrame(tracks, "storm_id long, storm_name string, step long, obs_date date")
    cells = [(storm, step, i, j, 10.25 + i, 120.25 + j, 1.0 + i + j + step, 2.0)
             for storm, _, step, _ in tracks for i in range(3) for j in range(3)]
    windows = spark.createDataFrame(cells, "storm_id long, step long, wi int, wj int, lat double, lon double, hazard double, asset double")
    edges = spark.createDataFrame(
        [(7, 120.0, 10.0, 122.0, 10.0), (7, 122.0, 10.0, 122.0, 12.0), (7, 122.0, 12.0, 120.0, 12.0), (7, 120.0, 12.0, 120.0, 10.0)],
        "unit_id long, x1 double, y1 double, x2 double, y2 double")
    units = spark.createDataFrame([(7, 1, "PHL", "PHL.1_1", "Leyte")], "unit_id long, level int, gid0 string, gid string, name string")
    lookup = spark.createDataFrame([(3, "PHL")], "country_id int, iso3_final string")
    record = "rec_id long, iso string, event_name string, start_year int, start_month int, start_day int, end_year int, " \
             "end_month int, end_day int, damage_adj_kusd double, damage_kusd double, gadm_units string, admin_units string"
    records = spark.createDataFrame([
        (1, "PHL", "Typhoon Haiyan (Yolanda)", 2013, 11, 8, 2013, 11, 8, 10.0, None, '[{"gid_1": "PHL.1_1"}]', None),
        (2, "PHL", "Tropical storm Zoraida", 2013, 11, 7, 2013, 11, 9, None, 4.0, None, None),
        (3, "PHL", "Haiyan", 2013, 11, 8, 2013, 11, 8, None, None, None, None),
        (4, "PHL", "Haiyan", 2010, 1, 1, 2010, 1, 2, 5.0, None, None, None),
        (5, "XXX", "Haiyan", 2013, 11, 8, 2013, 11, 8, 5.0, None, None, None)], record)
    shares = spark.createDataFrame([(s, p, i, j, 3, 0.5) for s, _, p, _ in tracks for i in range(3) for j in range(3)],
                                   "storm_id long, step long, wi int, wj int, country_id int, share double")
    return dict(records=records, track_points=track_points, windows=windows, units=units, edges=edges, lookup=lookup, shares=shares)


def test_losses_reach_the_right_cells(spark, season):
    got = attribution.attribute_losses(**season)
    summary = {r.rec_id: r for r in got.summary.collect()}
    assert {k: r.status for k, r in summary.items()} == {
        1: "allocated", 2: "allocated", 3: "missing_loss", 4: "unmatched", 5: "unmatched"}
    assert summary[1].allocated_usd == pytest.approx(10_000.0) and summary[2].allocated_usd == pytest.approx(4_000.0)
    assert max(r.conservation_error or 0.0 for k, r in summary.items() if r.status == "allocated") <= 1e-9
    matches = {r.rec_id: r for r in got.matches.collect()}
    assert matches[1].selected_storms == "1" and matches[2].selected_storms == "2" and matches[4].grade == "D"
    assert matches[1].source == "gadm_gid" and matches[2].source == "iso_country" and matches[5].source == "none"
    cells = got.cells.collect()
    assert sum(r.loss_usd for r in cells) == pytest.approx(14_000.0)
    paid = {(r.storm_id, r.wi, r.wj) for r in cells if r.loss_usd > 0}
    assert {(1, i, j) for i in range(2) for j in range(2)} == {c for c in paid if c[0] == 1}


def test_records_of_one_mask_share_their_weighted_cells(spark, season, tmp_path):
    def keep(df, name):
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    copies = spark.range(6).select(F.col("id").alias("copy"))
    records = season["records"].filter("rec_id = 1").crossJoin(copies).withColumn("rec_id", F.col("copy") + 1).drop("copy")
    got = attribution.attribute_losses(**{**season, "records": records}, keep=keep)
    # Two steps of four cells inside the unit for each of two days, once for all six records.
    assert spark.read.parquet(f"{tmp_path}/weights").count() == 16
    assert {(r.status, r.n_cells, round(r.allocated_usd, 6)) for r in got.summary.collect()} == {("allocated", 16, 10_000.0)}
    cells = got.cells.collect()
    assert {r.match_count for r in cells} == {6} and sum(r.weight_norm for r in cells) == pytest.approx(6.0)
    weight = {(r.step, r.wi, r.wj): 1.0 + r.wi + r.wj + r.step for r in cells}
    assert all(r.loss_usd == pytest.approx(60_000.0 * weight[r.step, r.wi, r.wj] / sum(weight.values())) for r in cells)


def test_same_day_steps_share_the_days_hazard(spark, season):
    cells = attribution.attribute_losses(**season).cells.filter("storm_id = 1 and wi = 0 and wj = 0").collect()
    loss = {r.step: r.loss_usd for r in cells}
    # Hazard is 1 + step; each day has two steps, so steps weigh 1, 2, 3 and 4 halves alike.
    assert loss[3] / loss[0] == pytest.approx(4.0)


def test_checkpoint_uses_the_named_folder(spark, tmp_path):
    df = session.cut_lineage(spark.range(5).withColumn("v", F.col("id") * 2), str(tmp_path))
    assert df.count() == 5 and "Scan ExistingRDD" in df._jdf.queryExecution().executedPlan().toString()


def test_assets_conserve_national_totals(spark):
    wide = spark.createDataFrame([("phl", "NY.GDP.MKTP.CD", "100", None), ("VNM", "NY.GDP.MKTP.CD", "50", "60"), ("VNM", "SP.POP.TOTL", "1", "1")],
                                 "iso3 string, indicator string, y2000 string, y2001 string")
    lookup = spark.createDataFrame([(1, " phl"), (2, "VNM"), (3, "CHN")], "country_id int, iso3_final string")
    totals = assets.national_totals(wide, lookup, "NY.GDP.MKTP.CD", 2000, 2001)
    assert totals.count() == 6 and totals.filter("is_missing = 1").count() == 3
    light = [(y, r, c, float(r + c)) for y in (2000, 2001) for r in range(4) for c in range(4)]
    people = [(y, r + 2, c, 1.0 + c) for y in (2000, 2001) for r in range(4) for c in range(4)]
    zones = [(r + 2, c, 1 if c < 2 else 2) for r in range(4) for c in range(4)]
    ddl = "year int, row long, col long, value double"
    layer = assets.asset_layer(spark.createDataFrame(light, ddl), spark.createDataFrame(people, ddl),
                               spark.createDataFrame(zones, "row long, col long, value int"), totals, row_offset=2)
    check = {(r.year, r.zone): (r.valid, r.realised) for r in assets.asset_conservation(layer, totals).collect()}
    assert check == {(2000, 1): (1, pytest.approx(100.0)), (2000, 2): (1, pytest.approx(50.0)), (2001, 2): (1, pytest.approx(60.0))}
    assert layer.filter("year = 2001 and zone = 1 and asset > 0").count() == 0


def test_matched_record_without_steps_in_its_days_weighs_nothing(spark, season):
    tracks = spark.createDataFrame([(1, "HAIYAN", 0, dt.date(2013, 11, 1)), (1, "HAIYAN", 1, dt.date(2013, 11, 11))],
                                   "storm_id long, storm_name string, step long, obs_date date")
    gap = season["records"].filter("rec_id = 1").withColumn("start_day", F.lit(5)).withColumn("end_day", F.lit(6))
    got = attribution.attribute_losses(**{**season, "records": gap, "track_points": tracks})
    row = got.summary.first()
    assert (row.status_prealloc, row.status, row.allocated_usd, row.conservation_error) == ("matched", "zero_weight", 0.0, 1.0)
    got.release()


def test_building_the_attribution_takes_no_job(spark, season):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "no job belongs here")
    attribution.attribute_losses(**season).release()
    assert list(tracker.getJobIdsForGroup("building")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
