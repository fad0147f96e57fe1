"""Table readers. Missing values become NULL here, so operators need not know the sentinels."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as tx
from ..functions.calendar import in_years, parse_date
from ..functions.missing import clean
from ..operators.keyed import first_per_key
from ..operators.tracks import parse_tracks

# The digest function travels with the plan, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed value: layout of daily rain file names.
RAIN_FILE = r"3IMERG\.(\d{8})-S"


def read_tracks(spark: SparkSession, path: str, basin: str | None = "WP", first: int | None = 2000,
                last: int | None = 2024) -> DataFrame:
    """Best-track CSV with a header and a units row."""
    raw = spark.read.schema(schemas.TRACK_RAW).option("header", True).csv(path)
    return parse_tracks(raw, basin, first, last)


def read_wide_indicator(spark: SparkSession, path: str, indicator: str, years: range) -> DataFrame:
    """Wide indicator CSV; preamble and header lines drop out because they carry no indicator code."""
    raw = spark.read.schema(schemas.wide_indicator(years)).option("mode", "PERMISSIVE").csv(path)
    return raw.filter(F.trim("indicator") == indicator).drop("indicator_name")


def read_records(spark: SparkSession, path: str, years: str | None = None) -> DataFrame:
    """Disaster records in Parquet or CSV, optionally of some start years."""
    reader = spark.read.schema(schemas.DISASTER_RECORDS)
    df = reader.option("header", True).option("escape", '"').csv(path) if path.endswith(".csv") else reader.parquet(path)
    return df.filter(in_years(F.col("start_year"), years)) if years else df


def read_cells(spark: SparkSession, path: str, layer: str | None = None, years: str | None = None) -> DataFrame:
    """Cell table; layer and year are partition columns, so both filters prune folders."""
    df = spark.read.schema(schemas.RASTER_CELLS).parquet(path)
    if layer is not None:
        df = df.filter(F.col("layer") == layer)
    if years is not None:
        df = df.filter(in_years(F.col("year"), years))
    return df.withColumn("value", clean(F.col("value")))


def country_lookup(df: DataFrame, required: Sequence[str] = ("iso3_final", "country_id")) -> DataFrame:
    """iso3_final in capitals and country_id; a table without these columns is refused. Of repeated codes the largest id counts."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"unexpected country lookup columns: {df.columns}, missing {missing}")
    iso = F.upper(F.trim("iso3_final"))
    return df.groupBy(iso.alias("iso3_final")).agg(F.max(F.col("country_id").cast("long")).alias("country_id"))


def read_country_lookup(spark: SparkSession, path: str) -> DataFrame:
    reader = spark.read.option("header", True)
    return country_lookup(reader.csv(path) if path.endswith(".csv") else spark.read.parquet(path))


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Audit CSV whose first header may start with a byte-order mark."""
    df = spark.read.option("header", True).csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def flood_catalog(docs: DataFrame, path: str = "path", years: Sequence[int] | None = None) -> DataFrame:
    """Flood documents with all required fields, one per id (the smallest path wins)."""
    parsed = (docs.withColumn("began", parse_date(F.col("began"))).withColumn("ended", parse_date(F.col("ended")))
              .withColumn("iso_set", tx.iso_tokens(F.col("cc")))
              .withColumn("main_cause", tx.cause(F.col("dfo_main_cause")))
              .withColumn("flood_id", F.trim("id")))
    complete = parsed.filter(F.col("flood_id").isNotNull() & (F.col("flood_id") != "") & F.col("began").isNotNull()
                             & F.col("ended").isNotNull() & F.col("tif").isNotNull() & (F.size("iso_set") > 0))
    if years is not None:
        complete = complete.filter(F.year("began").isin(list(years)))
    return first_per_key(complete, ["flood_id"], [F.col(path)]).select(
        "flood_id", "began", "ended", "iso_set", "main_cause", "tif", path)


def read_flood_catalog(spark: SparkSession, root: str, years: Sequence[int] | None = None) -> DataFrame:
    """Flood property files below a folder; unreadable ones are skipped."""
    docs = (spark.read.schema(schemas.FLOOD_DOC).option("multiLine", True).option("mode", "PERMISSIVE")
            .option("recursiveFileLookup", True).option("pathGlobFilter", "DFO_*_properties.json").json(root)
            .withColumn("path", F.col("_metadata.file_path")))
    return flood_catalog(docs, years=years)


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """File listing without contents (the content column is never read)."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True)
            .option("pathGlobFilter", pattern).load(root).select("path", "length", "modificationTime"))


def rain_days(files: DataFrame, path: str = "path") -> DataFrame:
    """Day of each daily rain file; other files drop out."""
    digits = F.regexp_extract(path, RAIN_FILE, 1)
    return (files.filter(digits != "").withColumn("day", F.try_to_timestamp(digits, F.lit("yyyyMMdd")).cast("date"))
            .filter(F.col("day").isNotNull()))


def first_match(files: DataFrame, keys: Sequence[str], patterns: Sequence[str], path: str = "path") -> DataFrame:
    """Per key, the file of the earliest pattern that fits."""
    rank = F.coalesce(*[F.when(F.col(path).rlike(p), F.lit(i)) for i, p in enumerate(patterns)])
    ranked = files.withColumn("pattern_rank", rank).filter(F.col("pattern_rank").isNotNull())
    return first_per_key(ranked, keys, [F.col("pattern_rank"), F.col(path)])


def classify_names(files: DataFrame, rules: dict[str, str], path: str = "path") -> DataFrame:
    """Kind of each file by the first rule (regular expression) that fits, else unknown."""
    kind = F.coalesce(*[F.when(F.col(path).rlike(rx), F.lit(name)) for name, rx in rules.items()], F.lit("unknown"))
    return files.withColumn("kind", kind)


def hyperslab(cells: DataFrame, row0: Column, col0: Column, height: int, width: int, spine: DataFrame,
              keys: Sequence[str] = ()) -> DataFrame:
    """Sub-grids of height x width per spine row; cells beyond the grid are NULL."""
    wanted = (spine.withColumn("row", F.explode(F.sequence(row0, row0 + height - 1)))
              .withColumn("col", F.explode(F.sequence(col0, col0 + width - 1))))
    return wanted.join(cells, [*keys, "row", "col"], "left")


def sample_bands(points: DataFrame, bands: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Multi-band values at points already placed on (row, col)."""
    return points.join(bands, [*keys, "row", "col"], "left")


def day_slice(grid: DataFrame, var: str, day, depth: int | None = None) -> DataFrame:
    picked = grid.filter((F.col("var") == var) & (F.col("day") == F.lit(day).cast("date")))
    return picked if depth is None else picked.filter(F.col("depth_idx") == depth)


def spliced_series(early: DataFrame, late: DataFrame, last_early: int, spine: DataFrame, year: str = "year") -> DataFrame:
    """Source A up to a year, source B after it; years without either are reported missing."""
    both = (early.filter(F.col(year) <= last_early).withColumn("method", F.lit("early"))
            .unionByName(late.filter(F.col(year) > last_early).withColumn("method", F.lit("late"))))
    return spine.join(both, year, "left").withColumn("method", F.coalesce("method", F.lit("missing")))


def list_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """path and length of every file below ``path``, empty ones left out; no content is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path).select("path", "length")


def open_file(path: str):
    """A seekable file, by the file systems Arrow knows."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path.replace("file:///", "/", 1) if path.startswith("file:") else path)
    return system.open_input_file(name)


def sampled_digests(files: DataFrame, part: int = 1 << 20) -> DataFrame:
    """path, length, bytes_read and digest of every listed file, which is opened where its row lies.

    The digest covers the size, the first ``part`` bytes, the middle ones of a file longer than two parts and the last ones of a
    file longer than one. Only these ranges are read, at any size of the file.
    """
    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, length in zip(batch["path"], batch["length"]):
                ranges = [(0, min(part, length))]
                ranges += [(length // 2 - part // 2, part)] if length > 2 * part else []
                ranges += [(length - part, part)] if length > part else []
                seen = hashlib.sha256(str(length).encode())
                with open_file(path) as f:
                    for start, size in ranges:
                        f.seek(start)
                        seen.update(f.read(size))
                out.append((path, length, sum(size for _, size in ranges), seen.hexdigest()))
            yield pd.DataFrame(out, columns=["path", "length", "bytes_read", "digest"])

    return files.select("path", "length").mapInPandas(apply, "path string, length long, bytes_read long, digest string")
