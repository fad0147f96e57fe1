import json

import pytest
from pyspark.sql import functions as F

from squallframe.operators import quality
from squallframe.sources import readers, sinks


def test_track_csv(spark, tmp_path):
    path = tmp_path / "tracks.csv"
    path.write_text(
        "SID,SEASON,NUMBER,BASIN,NAME,ISO_TIME,LAT,LON,WMO_WIND,WMO_PRES,USA_RMW\n"
        " ,Year, , , , ,degrees_north,degrees_east,kts,mb,nmile\n"
        "s1,2013,31,WP,HAIYAN,2013-11-07 18:00:00,10.8,126.0,125,895,-999\n"
        "s1,2013,x,WP,HAIYAN,07/11/2013,91,127.0, ,,\n"
        "s2,1999,1,WP,OLD,1999-01-01 00:00:00,1,1,1,1,1\n"
        "s3,2013,2,EP,OTHER,2013-01-01 00:00:00,1,1,1,1,1\n")
    got = readers.read_tracks(spark, str(path)).orderBy("number").collect()
    assert len(got) == 2
    assert got[0].number is None and got[0].ts is None and got[0].center_lat == 91.0 and got[0].wind_kt is None
    assert got[1].number == 31 and str(got[1].ts) == "2013-11-07 18:00:00" and got[1].rmw_nm is None


def test_wide_indicator_csv(spark, tmp_path):
    path = tmp_path / "gdp.csv"
    path.write_text('"Data Source","World Bank",\n\n"Last Updated","2024",\n\n'
                    '"Country Name","Country Code","Indicator Name","Indicator Code","2000","2001"\n'
                    '"Philippines","PHL","GDP (current US$)","NY.GDP.MKTP.CD","81","bad"\n'
                    '"Philippines","PHL","Population","SP.POP.TOTL","1","2"\n')
    rows = readers.read_wide_indicator(spark, str(path), "NY.GDP.MKTP.CD", range(2000, 2002)).collect()
    assert [(r.iso3, r.y2000, r.y2001) for r in rows] == [("PHL", "81", "bad")]


def test_flood_documents(spark, tmp_path):
    def doc(folder, number, **changes):
        base = {"id": str(number), "began": "2013-11-08", "ended": "2013-11-20", "cc": "PHL, VNM", "dfo_main_cause": " Heavy  Rain", "tif": "x.tif"}
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / f"DFO_{number}_properties.json").write_text(json.dumps(base | changes, indent=1))
    doc("a", 1)
    doc("b", 1, ended="2013-12-20")
    doc("b", 2, began="2012-01-01")
    doc("b", 3, tif=None)
    (tmp_path / "b" / "DFO_4_properties.json").write_text("{broken")
    (tmp_path / "b" / "other.json").write_text("{}")
    got = readers.read_flood_catalog(spark, str(tmp_path), [2013]).collect()
    assert [(r.flood_id, str(r.ended), r.iso_set, r.main_cause) for r in got] == [("1", "2013-11-20", ["PHL", "VNM"], "heavy rain")]


def test_audit_with_byte_order_mark(spark, tmp_path):
    (tmp_path / "audit.csv").write_bytes("﻿disno,iso\n2013-0433,PHL\n".encode())
    got = readers.read_audit(spark, str(tmp_path / "audit.csv"))
    assert got.columns == ["disno", "iso"] and got.count() == 1


def test_records_csv_with_json_columns(spark, tmp_path):
    names = "disno,iso,event_name,start_year,start_month,start_day,end_year,end_month,end_day,damage_adj_kusd,damage_kusd,admin_units,gadm_units"
    (tmp_path / "r.csv").write_text(names + '\n2013-0433-PHL,PHL,Haiyan,2013,11,8,2013,11,,1.5,,"[{""adm1_name"": ""Cebu""}]",\n')
    got = readers.read_records(spark, str(tmp_path / "r.csv"), "2013-2014").first()
    assert got.admin_units == '[{"adm1_name": "Cebu"}]' and got.end_day is None and got.damage_adj_kusd == 1.5
    assert readers.read_records(spark, str(tmp_path / "r.csv"), "2012").count() == 0


def test_partitions_are_replaced_one_by_one_and_pruned(spark, tmp_path):
    path = str(tmp_path / "cells")
    rows = [("ntl", 2000, 0, 0, 1.0), ("ntl", 2001, 0, 0, 2.0)]
    ddl = "layer string, year int, row long, col long, value double"
    sinks.write_partitions(spark.createDataFrame(rows, ddl), path, ["layer", "year"], ["row", "col"])
    sinks.write_partitions(spark.createDataFrame([("ntl", 2001, 0, 0, -9999.0)], ddl), path, ["layer", "year"], ["row", "col"])
    got = readers.read_cells(spark, path, "ntl", "2000-2001")
    assert {r.year: r.value for r in got.collect()} == {2000: 1.0, 2001: None}
    plan = readers.read_cells(spark, path, "ntl", "2000")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(layer" in plan and "year" in plan.split("PartitionFilters")[1]
    planned = spark.createDataFrame([("ntl", 2000), ("ntl", 2002)], "layer string, year int")
    assert [r.year for r in sinks.pending(planned, got, ["layer", "year"]).collect()] == [2002]


def test_tables_and_manifests_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    sinks.write_table(df, str(tmp_path / "t"), "csv")
    sinks.write_manifest(df, str(tmp_path / "m"))
    assert spark.read.option("header", True).csv(str(tmp_path / "t")).first().y == "a"
    assert spark.read.json(str(tmp_path / "m")).first().x == 1


def test_existing_variables_are_not_overwritten(spark):
    stage = spark.createDataFrame([(1, 2.0)], "k int, v double")
    extra = spark.createDataFrame([(1, 3.0)], "k int, v double")
    with pytest.raises(ValueError, match="already present"):
        sinks.enrich(stage, extra, ["k"], ["v"])
    assert sinks.enrich(stage, extra, ["k"], ["v"], overwrite=True).first().v == 3.0


def test_packed_windows_are_in_row_order(spark):
    df = spark.createDataFrame([(1, 1, 0, 3.0), (1, 0, 1, None), (1, 0, 0, 1.0), (1, 1, 1, 4.0)], "s int, wi int, wj int, v double")
    assert sinks.packed_windows(df, ["s"], "v", size=2).first().v == [1.0, -9999.0, 3.0, 4.0]


def test_listing_snapshots(spark, tmp_path):
    (tmp_path / "3B-DAY.MS.MRG.3IMERG.20131108-S000000.nc4").write_bytes(b"abc")
    (tmp_path / "notes.txt").write_bytes(b"x")
    files = readers.list_files(spark, str(tmp_path))
    days = readers.rain_days(files).collect()
    assert [str(r.day) for r in days] == ["2013-11-08"] and days[0].length == 3
    before = files.withColumn("digest", F.lit("d")).collect()
    (tmp_path / "notes.txt").write_bytes(b"xy")
    old = spark.createDataFrame(before, files.withColumn("digest", F.lit("d")).schema)
    now = readers.list_files(spark, str(tmp_path)).withColumn("digest", F.lit("d"))
    diff = quality.snapshot_diff(old, now).collect()
    assert [(r.path.rsplit("/", 1)[1], r.issue) for r in diff] == [("notes.txt", "changed")]
