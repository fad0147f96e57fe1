"""Query ``op11_filter_audit`` and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .filter_audit import interaction_audit
from .shared import stored, whole_text

NAME = "op11_filter_audit"
WORD = r"[^\x20\x09-\x0D]+"


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each document: lang, which of the five conditions it fails (a to e), and whether a label calls it good or toxic.

    Texts are read once; what they are compared by is their digest. Only digests with a copy are looked up, from a table, so that both
    sides are plain shuffles and a text that many documents share is met in parts (adaptive skew join). A null id is smaller than none.
    """
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    given = docs.select("doc_id", F.col("lang").alias("part"), whole_text("text").alias("text")).withColumn("words", words)
    n = F.size("words")
    facts = stored(given.select(
        "doc_id", "part", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), (n < 100).alias("a"),
        (100 * F.size(F.array_distinct("words")) < 80 * n).alias("b"),
        (100 * F.length(F.regexp_replace("text", "[^A-Z]+", "")) > 10 * F.length("text")).alias("c"), F.col("text").rlike(r"[#$%&*|]").alias("d")))
    firsts = stored(facts.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").drop("last"))
    marks = labels.groupBy(F.col("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    return (facts.join(firsts, "digest", "left").join(marks, "doc_id", "left")
            .select("part", "a", "b", "c", "d", (F.col("doc_id") > F.col("first")).alias("e"), "good", "toxic"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    fails = {name.upper(): F.col(name) for name in "abcde"}
    return interaction_audit(judged(docs, labels), F.col("part"), fails, {"good_lost": F.col("good"), "toxic_lost": F.col("toxic")})


def query(spark: SparkSession, folder: str) -> DataFrame:
    return audit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
f AS (
  SELECT part, len(words) < 100 AS A, 100 * len(list_distinct(words)) < 80 * len(words) AS B,
         100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS C, regexp_matches(text, '[#$%&*|]') AS D,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), FALSE) AS E,
         doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic
  FROM w
), m AS (
  SELECT part, (A::INT) + (B::INT) * 2 + (C::INT) * 4 + (D::INT) * 8 + (E::INT) * 16 AS mask, count(*) AS n,
         count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), steps AS (
  SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS bit,
         CAST(coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))), 0) AS BIGINT) AS before
  FROM orders, range(1, 6) r(step)
), counted AS (
  SELECT part, filter_order, step, bit, coalesce(sum(n) FILTER (WHERE mask & (before | bit) = 0), 0) AS kept,
         coalesce(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & before = 0), 0) AS removed,
         coalesce(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & before <> 0), 0) AS redundant,
         coalesce(sum(n) FILTER (WHERE mask = bit), 0) AS unique_fails,
         coalesce(sum(good) FILTER (WHERE mask & bit <> 0 AND mask & before = 0), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (WHERE mask & bit <> 0 AND mask & before = 0), 0) AS toxic_lost
  FROM m, steps GROUP BY ALL
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM counted
"""
