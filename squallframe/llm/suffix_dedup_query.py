"""Query ``op3_suffix_dedup``; tested against brute force, as SQL would need a row for every byte."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .suffix_dedup import without_repeats

NAME, SQL = "op3_suffix_dedup", None


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return without_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
