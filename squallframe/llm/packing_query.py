"""Query ``op2_best_fit_packing``; token ids have no SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .packing import pack
from .shared import stored
from .token_pieces import token_pieces

NAME, SQL = "op2_best_fit_packing", None
CAPACITY = 4096


def packed_documents(docs: DataFrame) -> DataFrame:
    return pack(stored(token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), CAPACITY)), CAPACITY)


def query(spark: SparkSession, folder: str) -> DataFrame:
    return packed_documents(spark.read.parquet(f"{folder}/documents.parquet"))
