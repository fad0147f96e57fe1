"""Query ``op4_language_id``; tested by held-out accuracy and against a plain version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .language_id import learn, predict
from .shared import crc_fold

NAME, SQL = "op4_language_id", None


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang")
    profiles = learn(docs, crc_fold("doc_id", 4) != 2)
    return predict(docs, profiles).select(
        "doc_id", F.coalesce(crc_fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
