"""Query ``op7_mil_quality``; tested by held-out accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .mil_quality import learn, score
from .shared import crc_fold

NAME, SQL = "op7_mil_quality", None
THRESHOLD = 0.3


def scored_documents(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All columns of the documents and ``score``, learnt from the learnable rows of ``labels``."""
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    return score(docs, learn(docs, labels, crc_fold("doc_id", 5) != 0))


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    return scored_documents(spark, docs, folder).select(
        "doc_id", F.coalesce(crc_fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
