"""Declared schemas of the inputs: text files are never inferred."""

from __future__ import annotations

from pyspark.sql import types as T


TYPES = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(),
         "date": T.DateType()}


def _schema(text: str) -> T.StructType:
    """``name type, name type`` without needing a running session."""
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in (f.split() for f in text.split(","))])


TRACK_RAW = _schema("SID string, SEASON string, NUMBER string, BASIN string, NAME string, ISO_TIME string, "
                    "LAT string, LON string, WMO_WIND string, WMO_PRES string, USA_RMW string")
RASTER_CELLS = _schema("layer string, year int, row bigint, col bigint, value double")
DAILY_GRID = _schema("var string, day date, lat_idx bigint, lon_idx bigint, value double")
OCEAN_GRID = _schema("var string, day date, depth_idx int, lat_idx bigint, lon_idx bigint, value double")
PRECIP_DAILY = _schema("day date, i_lon bigint, j_lat bigint, precipitation double, mw_precipitation double, "
                       "random_error double, cnt double, cnt_cond double")
DISASTER_RECORDS = _schema(
    "disno string, iso string, event_name string, start_year int, start_month int, start_day int, "
    "end_year int, end_month int, end_day int, damage_adj_kusd double, damage_kusd double, "
    "admin_units string, gadm_units string")
ADMIN_UNITS = _schema("unit_id bigint, level int, gid0 string, gid string, name string")
ADMIN_EDGES = _schema("unit_id bigint, x1 double, y1 double, x2 double, y2 double")
COUNTRY_LOOKUP = _schema("country_id int, iso3_final string, country_name string, parts_count int, "
                         "disputed_parts_count int")
FLOOD_DOC = _schema("id string, began string, ended string, cc string, dfo_main_cause string, tif string")


def wide_indicator(years: range) -> T.StructType:
    """Indicator table with one text column per year."""
    names = ["country_name", "iso3", "indicator_name", "indicator", *[f"y{y}" for y in years]]
    return T.StructType([T.StructField(n, T.StringType()) for n in names])
