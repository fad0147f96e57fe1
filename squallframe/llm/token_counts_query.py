"""Query ``op13_token_counts``; merges of a vocabulary have no SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .token_counts import token_counts

NAME, SQL = "op13_token_counts", None
LIMIT = 1024


def query(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{folder}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), LIMIT)
