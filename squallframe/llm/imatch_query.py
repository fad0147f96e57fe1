"""Query ``op5_imatch``; fingerprints depend on corpus counts and have no SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .imatch import fingerprint_text, fingerprints, lexicon, likeness, range_bounds, with_next
from .shared import hash_slots, stored, whole_text

NAME, SQL = "op5_imatch", None
#: Stands for a null id: before every other.
NULL_ID = -2**63


def fingerprinted(docs: DataFrame) -> DataFrame:
    """One row for each document; those that repeat an id and text exactly are fingerprinted once and each reported.

    Documents that share an id stand in order of a hash of their texts, those without an id stand first. Texts are
    shuffled once, by ranges of ids: a document, its successor and so its edited text lie together.
    """
    given = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), whole_text("text").alias("text")).withColumn("key", F.xxhash64("text"))
    words = stored(lexicon(given))
    rows = with_next(given, range_bounds(given, "id", hash_slots(docs.sparkSession)))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    rows = rows.withColumn("edited", edited)
    on = ["range", "id", "key"]
    # Both branches read the same columns, so Spark shuffles the texts once for the two.
    facts = rows.select(*on, F.length("text").cast("long").alias("n_chars"), "next_id", "next_key",
                        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.xxhash64("edited").alias("edited_key"))
    slots = fingerprints(rows, on, words, ["text", "edited"])
    told = stored(facts.join(slots, on).drop("range"))
    after = told.select(F.col("id").alias("next_id"), F.col("key").alias("next_key"), F.col("text").alias("next_slots"))
    again = given.groupBy("id", "key").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    each = F.explode(F.array_repeat(F.lit(0), F.coalesce("rows", F.lit(1)).cast("int")))
    met = told.join(after, ["next_id", "next_key"]).join(again, ["id", "key"], "left").withColumn("copy", each)
    return (met
            .select(F.when(F.col("id") != NULL_ID, F.col("id")).alias("doc_id"), "n_chars", "edited_sha256",
                    fingerprint_text(F.col("text")).alias("fingerprint"), fingerprint_text(F.col("edited")).alias("edited_fingerprint"),
                    likeness(F.col("text"), F.col("edited"), F.col("key") == F.col("edited_key")).alias("near_edited"),
                    likeness(F.col("text"), F.col("next_slots"), F.col("key") == F.col("next_key")).alias("near_next")))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprinted(spark.read.parquet(f"{folder}/documents.parquet"))
