"""Query ``op10_disclosure``; the added spans depend on corpus counts, so there is no SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .disclosure import KINDS, PATTERNS, find_personal_data, span_text

NAME, SQL = "op10_disclosure", None


def query(spark: SparkSession, folder: str) -> DataFrame:
    found = find_personal_data(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(span_text(tuple(PATTERNS)).cast("binary"), 256).alias("base_sha256"), span_text(KINDS).alias("spans"))
