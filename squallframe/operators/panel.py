"""Country panels: wide tables, overrides, lookups and coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keyed import first_per_key, rank_rows

# Codes of disputed areas and the country each is counted with.
DISPUTED_PARENTS = {
    "Z01": "IND", "Z02": "CHN", "Z03": "CHN", "Z04": "IND", "Z05": "IND",
    "Z06": "PAK", "Z07": "IND", "Z08": "CHN", "Z09": "IND",
}


def indicator_rows(wide: DataFrame, indicator: str, code: str = "indicator",
                   required: Sequence[str] | None = None) -> DataFrame:
    """Rows of one indicator with the required columns only, text trimmed."""
    columns = list(required or wide.columns)
    missing = [c for c in columns if c not in wide.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    texts = {name for name, kind in wide.dtypes if kind == "string"}
    return wide.filter(F.trim(code) == indicator).select(
        *[F.trim(c).alias(c) if c in texts else F.col(c) for c in columns])


def wide_to_long(wide: DataFrame, ids: Sequence[str], years: Sequence[int], value: str = "gdp") -> DataFrame:
    """One row per key and year from one column per year; unparsable text is NULL."""
    picked = wide.select(*ids, *[F.col(f"y{y}").try_cast("double").alias(str(y)) for y in years])
    long = picked.unpivot(list(ids), [str(y) for y in years], "year", value)
    return long.withColumn("year", F.col("year").cast("int"))


def long_to_wide(long: DataFrame, keys: Sequence[str], years: Sequence[int], value: str) -> DataFrame:
    """Pivot with an explicit list of years, so absent years still get a column."""
    return long.groupBy(*keys).pivot("year", list(years)).agg(F.max(value)).withColumnsRenamed(
        {str(y): f"y{y}" for y in years})


def dense_panel(keys: DataFrame, first: int, last: int) -> DataFrame:
    """Every key with every year."""
    return keys.distinct().withColumn("year", F.explode(F.sequence(F.lit(first), F.lit(last))))


def fill_panel(panel: DataFrame, facts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Facts on the full panel; missing ones become 0 with a flag."""
    joined = panel.join(facts, list(keys), "left")
    return (joined.withColumn("is_missing", F.col(value).isNull().cast("int"))
            .withColumn(value, F.coalesce(value, F.lit(0.0))))


def apply_overrides(df: DataFrame, overrides: DataFrame, code: str) -> DataFrame:
    """Codes replaced by their parent where a rule exists, with flag and parent kept."""
    rules = overrides.select(F.col("code").alias(code), "parent")
    return (df.join(rules, code, "left")
            .withColumn("is_disputed", F.col("parent").isNotNull().cast("int"))
            .withColumn("iso3_final", F.coalesce("parent", code))
            .withColumn("rule", F.when(F.col("parent").isNotNull(), F.concat_ws("->", code, "parent"))))


def number_zones(df: DataFrame, code: str, out: str = "country_id") -> DataFrame:
    """Zone ids in code order; codes are ranked among those of the same first letters, so no task holds them all."""
    ids = rank_rows(df.select(code).distinct(), [], [F.col(code)], F.substring(code, 1, 3), out)
    return df.join(ids, code)


def preferred_name(df: DataFrame, key: str, name: str, disputed: str, order: str) -> DataFrame:
    """A key's name from its undisputed parts if any, else the first by order."""
    return first_per_key(df, [key], [F.col(disputed), F.col(order)]).select(key, name)


def zone_parts(df: DataFrame, key: str, disputed: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("parts_count"),
                               F.count_if(F.col(disputed) == 1).alias("disputed_parts_count"))
