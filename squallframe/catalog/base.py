"""Registry of named queries, each with the SQL that states the same result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Tables:
    """Attribute access to the Parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under a name."""
    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            SQL[name] = sql
        return fn
    return register


_SCRATCH: dict[tuple[str, str], str] = {}


def scratch_table(t: Tables, name: str) -> str:
    """A new name for a table a query writes to the warehouse; the session's table of the run before is dropped."""
    held = (t.spark.sparkContext.applicationId, name)
    if held in _SCRATCH:
        t.spark.sql(f"DROP TABLE IF EXISTS {_SCRATCH[held]}")
    _SCRATCH[held] = f"{name}_{uuid.uuid4().hex}"
    return _SCRATCH[held]


def rounded(col, digits: int = 6) -> Column:
    """Round half up in plain double steps, the same in every SQL engine."""
    scale = 10.0 ** digits
    value = (F.col(col) if isinstance(col, str) else col).cast("double")
    return F.floor(value * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def R(expr: str, digits: int = 6) -> str:
    """SQL text of ``rounded``."""
    scale = f"{10 ** digits}.0::DOUBLE"
    return f"(floor(CAST({expr} AS DOUBLE) * {scale} + 0.5::DOUBLE) / {scale})"


def big(col) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("bigint")


def money(col) -> Column:
    """Order-independent sum of cents."""
    return F.sum((F.col(col) if isinstance(col, str) else col).cast("decimal(18,2)")).cast("double")


def MONEY(expr: str) -> str:
    return f"CAST(sum(CAST({expr} AS DECIMAL(18,2))) AS DOUBLE)"


def n_rows() -> Column:
    return F.count(F.lit(1)).alias("n")
