"""Query ``op9_piece_scan``; tested against the sentencepiece library and by reading back."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .piece_scan import encode_documents

NAME, SQL = "op9_piece_scan", None


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Encode every document and digest its ids and what they read back to."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return encode_documents(docs, path, read_back=True).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"), F.crc32("ids").alias("ids_crc32"),
        F.length("text").cast("long").alias("decoded_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
